"""Operators that compare texts, models, shards and the pipeline, against brute-force versions and SQL."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402
from veilspark.llm import (  # noqa: E402
    components,
    exact_duplicates,
    near_duplicates,
    quality,
    queries,
    repeated_passages,
    sharding,
    toxicity,
)

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.ORACLES[name]) is None


def documents(spark, rows):
    return spark.createDataFrame([(i, t, True, 0) for i, t in rows], "doc_id long, text string, kept boolean, n_bytes int")


ODD = [(70, None), (71, ""), (72, " \t"), (73, "one"), (74, "one"), (74, "one"), (75, "ONE\n"), (None, "two words"), (None, "two words"), (None, "x")]


def test_exact_duplicates(spark):
    rows = ODD + [(i, "hot  text") for i in range(100, 400)] + [(i, f"own {i}") for i in range(400, 500)]
    got = exact_duplicates.exact_duplicates(documents(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        ordered = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ordered):
            want[i, keep, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_duplicates.exact_duplicates(documents(spark, rows).limit(0)).count() == 0
    whole = documents(spark, rows).drop("kept")
    assert exact_duplicates.drop_exact_duplicates(whole).count() == len(groups)
    with pytest.raises(ValueError):
        exact_duplicates.drop_exact_duplicates(documents(spark, rows))


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1))


def near(rows, words, percent=80):
    sets = [(i, shingles(t, words)) for i, t in rows]
    owner = list(range(len(sets)))

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for (a, (_, s)), (b, (_, t)) in combinations(list(enumerate(sets)), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            owner[root(a)] = root(b)
    least = {}
    for n, (i, s) in enumerate(sets):
        if s and i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return Counter((i, len(s), (least.get(root(n)) if s else i)) for n, (i, s) in enumerate(sets))


def test_near_duplicates_of_a_family_around_one_text(spark):
    """Copies that their centre resembles too little are still linked with each other."""
    import random

    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = list(ODD)
    for i in range(200, 420):
        words = list(base)
        for place in rng.sample(range(120), rng.choice([2, 5, 9, 14, 20])):
            words[place] = f"v{rng.randrange(4)}" if rng.random() < 0.7 else f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, f"alone {i} " + " ".join(f"z{i}_{k}" for k in range(i % 7))) for i in range(500, 540)]
    for words in (2, 5):
        got = near_duplicates.near_duplicates(documents(spark, rows), words=words).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near_duplicates.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 140)}


def repeats(rows, length=repeated_passages.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        spans = []
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)]))
        out.append((i, kept, tuple(map(tuple, spans))))
    return Counter(out)


@pytest.mark.parametrize("group", [8192, 2])
def test_repeated_passages(spark, group):
    import random

    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(500))
    rows = ODD + [(1, "ab" * 900), (2, "x" * 399), (3, "x" * 400), (4, "y" * 401), (5, "abc" * 200 + "Z" + "abc" * 200)]
    rows += [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 600))) + passage[rng.randint(0, 150) :] + str(i)) for i in range(20, 45)]
    rows += [(50, passage), (50, passage), (51, passage[:399])]
    got = repeated_passages.without_repeats(documents(spark, rows), group=group).collect()
    assert Counter((r[0], bytes(r[1]), tuple(map(tuple, r[2]))) for r in got) == repeats(rows)
    assert repeated_passages.without_repeats(documents(spark, rows).limit(0)).count() == 0


def test_shards_fit_and_do_not_split_without_need(spark):
    rows = ODD + [(i, "x" * (i % 37)) for i in range(1000, 3000)] + [(9, "y" * 5000)]
    df = documents(spark, rows)
    got = sharding.shards(df, 700).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    place = {r.doc_id: r.p for r in df.select("doc_id", sharding.place("doc_id").alias("p")).collect()}
    for shard, members in by.items():
        total = sum(r.n_bytes for r in members)
        assert {(r.shard_bytes, r.shard_rows, r.depth) for r in members} == {(total, len(members), len(shard) - 1)}
        assert total <= 700 or len({place[r.doc_id] for r in members}) == 1
        if len(shard) > 1:  # its parent was too large
            parent = [r for r in got if bin(place[r.doc_id])[2:].zfill(60).startswith(shard[1:-1])]
            assert sum(r.n_bytes for r in parent) > 700
    assert sharding.shards(df.limit(0), 10).count() == 0
    assert {r.shard for r in sharding.shards(df, 10**9).collect()} == {"b"}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 600)
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.sum(F.length("text")).alias("n")).collect()
    assert sum(r.n for r in found) == 5000 and max(r.n for r in found) <= 600


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    good = [(i, f"a plain sentence about {['cats', 'dogs', 'rain'][i % 3]} and some {i} more words. " * (1 + i % 4)) for i in range(300)]
    junk = [(i, f"BUY!! NOW!! {i}%%% ***$$$ ||| " * 9) for i in range(1000, 1060)]
    df = documents(spark, good + junk + [(5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in junk[:30]] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    rows = {r.doc_id: r for r in quality.importance_sample(df, model).collect()}
    assert sum(rows[i].kept for i, _ in good) >= 297 and not any(rows[i].kept for i, _ in junk)
    assert rows[5000].log_weight == rows[5001].log_weight == 0
    assert quality.importance_sample(df, model, k=25).where("kept").count() == 25
    assert quality.importance_sample(df, model, k=10**6).where("kept").count() == df.count()
    assert quality.good_documents(df, labels).columns == df.columns
    assert quality.good_documents(df, labels.limit(0)).count() == df.count()
    assert quality.good_documents(df.limit(0), labels).count() == 0


def test_quality_weight_is_the_ratio_of_the_models(spark):
    """The weight of a text against one worked out bucket by bucket."""
    import numpy as np

    model = quality.QualityModel(np.arange(quality._SIZE) / 1000.0, 0.0, 1)
    texts = ["abcd", "ab", "", "x y x y  x", "é" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.log_weight for r in quality.importance_sample(df, model).orderBy("doc_id").collect()]
    want = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        parts = quality._features(data, np.array([0, len(data)]))
        want.append(sum(float(model.ratios[int(b)]) for buckets, _ in parts for b in buckets))
    assert got == pytest.approx(want)
    assert len(list(quality._features(np.frombuffer(b"abcd", np.uint8), np.array([0, 4])))[0][0]) == 2


def test_toxicity_on_held_out_rows(spark):
    documents_ = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text")
    slurs = ["vile", "rotten", "filthy"]
    rows = documents_.withColumn(
        "label", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).cast("int")
    ).withColumn("text", F.when(F.col("label") == 1, F.concat("text", F.lit(" you "), F.element_at(F.array(*map(F.lit, slurs)), (F.col("doc_id") % 3 + 1).cast("int")))).otherwise(F.col("text")))
    model = toxicity.train(rows.drop("label"), rows.select("doc_id", F.col("label").alias("toxic")))
    scored = toxicity.toxicity_scores(rows, model).where(toxicity.held_out("doc_id"))
    right = scored.select(((F.col("score") >= 0.3).cast("int") == F.col("label")).alias("ok")).agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert right > 0.95


def test_toxicity_without_labels_or_words(spark):
    df = spark.createDataFrame([(1, None, "en", 0), (2, "", None, 1), (2, "", None, 1), (3, "w " * 9000, "xx", 2)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    rows = toxicity.toxicity_scores(df, model).collect()
    assert len(rows) == 4 and all(0 <= r.score < 0.5 and r.toxic is False for r in rows)
    assert toxicity.toxicity_scores(df.limit(0), model).count() == 0


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours():
    import numpy as np

    model = toxicity.ToxicityModel.new(3)
    texts = [b"one two", b"", b"three", b"four five six seven", b""]
    offsets = np.cumsum([0, *map(len, texts)])
    together = model.scores(*toxicity._word_ids(np.frombuffer(b"".join(texts), np.uint8), offsets))
    alone = [model.scores(*toxicity._word_ids(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-6)


def test_pipeline_against_brute_force(spark):
    """The stages after the classifier against plain Python over what it kept."""
    import tiktoken
    import public_tokenizers
    from test_text_operators import contaminated

    from veilspark.llm import byte_bpe

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert first.columns == docs.columns
    rows, seen = [], set()
    for i, t in sorted((r.doc_id, r.text) for r in first.collect()):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if norm not in seen:
            seen.add(norm)
            rows.append((i, t))
    rows = _kept(rows)
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = contaminated(rows, bench, 10)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(t or "") for i, t in rows if not bad[i][4]}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.intact and r.n_tokens == len(r.ids) for r in got)


def _kept(rows):
    found = near(rows, 5)
    return [(i, t) for i, t in rows if (i, len(shingles(t, 5)), i) in found]


def test_exact_duplicates_of_any_column_names(spark):
    df = spark.createDataFrame([(1, "a  b", "x", 7, "h"), (2, "a b", "y", 8, "i"), (3, "c", None, 9, "j")],
                               "doc_id long, text string, kept string, group_size int, text_sha256 string")
    got = exact_duplicates.drop_exact_duplicates(df, any_names=True)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a  b", "x", 7, "h"), (3, "c", None, 9, "j")]


def test_a_passage_in_most_documents_over_several_batches(spark):
    """Copies of one passage make most pieces of a key, and each task gets several batches."""
    import random

    rng = random.Random(11)
    passage = "".join(rng.choice("abcdef gh") for _ in range(1400))
    own = lambda n: "".join(rng.choice("klmnop qr") for _ in range(n))
    rows = [(i, own(rng.randint(0, 300)) + passage + own(rng.randint(0, 300))) for i in range(60)]
    rows += [(100 + i, passage[:700] + own(500)) for i in range(20)] + [(200 + i, own(700)) for i in range(20)]
    former = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = repeated_passages.without_repeats(documents(spark, rows).repartition(2), group=16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", former)
    assert Counter((r[0], bytes(r[1]), tuple(map(tuple, r[2]))) for r in got) == repeats(rows)
