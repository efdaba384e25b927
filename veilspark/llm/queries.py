"""One query for each operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.llm import (
    byte_bpe,
    collocations,
    decontamination,
    exact_duplicates,
    near_duplicates,
    personal_data,
    quality,
    repeated_passages,
    sharding,
    source_divergence,
    token_counts,
    token_files,
    toxicity,
)
from veilspark.llm.tables import small_batches
from veilspark.sources.storage import shared_folder

TOKEN_LIMIT = 512
TOXIC_SCORE = 0.3
SHARD_BYTES = 16 << 20
END_ID = 2
SHINGLE_WORDS, SHINGLE_PERCENT = 2, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.token_counts(_documents(spark, sf_dir), path, limit=TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_documents(spark, sf_dir), words=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_and_decode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(documents, model)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
        "toxic",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    model = quality.fit(documents, _table(spark, sf_dir, "labels"))
    return quality.importance_sample(documents, model).drop("text")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf_dir), SHARD_BYTES)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`shortened` says whether anything was removed, `excerpt` whether what was removed is the lesser part of the text: a passage that
    the text shares with others, and not a copy as a whole."""
    left = repeated_passages.without_repeats(_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    counted = left.select(
        "doc_id",
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    some = F.col("n_removed") > 0
    return counted.select("*", some.alias("shortened"), (some & (2 * F.col("n_removed") < F.col("n_bytes"))).alias("excerpt"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontamination.RESULTS)


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates.exact_duplicates(_documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    model = personal_data.train(documents)
    return personal_data.personal_data(documents, model).select("doc_id", *personal_data.RESULTS)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, path = _documents(spark, sf_dir), shared_folder(spark, "token-files")
    token_files.write_tokens(documents, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)
    read = token_files.read_tokens(spark, path, documents.schema["doc_id"].dataType)
    return read.select("doc_id", "start", "n_tokens", token_files.ids_crc32("ids").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OPERATORS = [
    op1_token_counts, op2_near_duplicates, op3_byte_bpe, op4_toxicity, op5_quality, op6_shards, op7_repeated_passages,
    op8_contamination, op9_exact_duplicates, op10_personal_data, op11_source_divergence,
    op12_collocations, op13_token_files, pipeline,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{ascii_uppercase}', '{ascii_lowercase}')"


_NEAR = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2
    THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= {SHINGLE_PERCENT} * (x.n + y.n - c)
), reach(doc_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least_one AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
  least(doc_id, coalesce(other, doc_id)) = doc_id AS kept
FROM sizes LEFT JOIN least_one USING (doc_id)
"""

_SHARDS = f"""
WITH placed AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS b FROM documents
), buckets AS (
  SELECT depth, h >> (60 - depth) AS prefix, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS n, min(h) AS low, max(h) AS high
  FROM placed, (SELECT CAST(range AS INT) AS depth FROM range(0, 61)) d GROUP BY 1, 2
), fitting AS (SELECT * FROM buckets WHERE bytes <= {SHARD_BYTES} OR low = high),
leaves AS (
  SELECT doc_id, b, min(depth) AS depth FROM placed JOIN fitting ON prefix = h >> (60 - depth) GROUP BY 1, 2
)
SELECT p.doc_id, p.b AS n_bytes,
  'b' || CASE WHEN l.depth = 0 THEN '' ELSE lpad(to_base(f.prefix, 2), l.depth, '0') END AS shard,
  l.depth, f.bytes AS shard_bytes, f.n AS shard_rows
FROM placed p JOIN leaves l USING (doc_id) JOIN fitting f ON f.depth = l.depth AND f.prefix = p.h >> (60 - l.depth)
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_CONTAMINATION = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lowered("text")}, '{_WORD}') AS w FROM benchmark
), windows AS (
  SELECT item, least(len(w), {decontamination.WINDOW}) AS size,
    unnest(list_transform(range(1, greatest(len(w) - {decontamination.WINDOW} + 2, 2)),
      lambda i: list_slice(w, i, i + least(len(w), {decontamination.WINDOW}) - 1))) AS win
  FROM items WHERE len(w) > 0
), docs AS (
  SELECT doc_id, regexp_extract_all({_lowered("text")}, '{_WORD}') AS w FROM documents
), places AS (
  SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT size FROM windows)
  WHERE i + size - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, p.size, item FROM places p JOIN windows v ON v.size = p.size AND v.win = p.win
), words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words_hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(words_hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_EXACT = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

_DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_lowered("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), words AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {source_divergence.LEAST_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang)
  LEFT JOIN counts USING (lang, source, term)
), whole AS (SELECT lang, term, sum(c)::BIGINT AS c FROM cells GROUP BY ALL),
p AS (
  SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER s + 5 * count(*) OVER s) AS p
  FROM cells WINDOW s AS (PARTITION BY lang, source)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER s + 5 * count(*) OVER s) AS q
  FROM whole WINDOW s AS (PARTITION BY lang)
), sides AS (SELECT a.lang, a.source, b.source AS item FROM (SELECT DISTINCT lang, source FROM d) a
  JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM sides LEFT JOIN sums USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM rows
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {source_divergence.TOP_TERMS}
"""

_COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lowered("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS sizes(k)
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {collocations.LEAST}),
places AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, cut, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM places c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(list_slice(w, 1, 2), ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(list_slice(w, 2, 3), ' '), a FROM candidates WHERE k = 3) GROUP BY ALL
), left_over AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON b.k = 2 AND i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < {collocations.PERCENT} * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1) USING (lang) WHERE rank <= {collocations.TOP}
"""

ORACLES: dict[str, str] = {
    "op2_near_duplicates": _NEAR,
    "op6_shards": _SHARDS,
    "op8_contamination": _CONTAMINATION,
    "op9_exact_duplicates": _EXACT,
    "op11_source_divergence": _DIVERGENCE,
    "op12_collocations": _COLLOCATIONS,
}
