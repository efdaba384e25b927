"""Detection and anonymization of text tables, one narrow stage each unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.config import EngineConfig
from veilspark.functions import anonymizers, recognizers, spans as sp, tokens
from veilspark.functions.recognizers import DEFAULT_REGISTRY, Recognizer
from veilspark.operators.rows import one_row_each

ENTITIES = "entities"


def analyze(
    df: DataFrame,
    text_col: str = "text",
    registry: Iterable[Recognizer] = DEFAULT_REGISTRY,
    threshold: float | None = None,
    config: EngineConfig = EngineConfig(),
    extra: Iterable[Column] = (),
) -> DataFrame:
    """Add ``entities``, ``array<struct<entity_type, start, end, score, text_preview>>``."""
    limit = config.score_threshold if threshold is None else threshold
    return df.withColumn(ENTITIES, recognizers.analyze(F.col(text_col), registry, limit, extra))


def without_previews(entities: Column) -> Column:
    return F.transform(
        entities, lambda e: e.withField("text_preview", F.lit(None).cast("string"))
    )


def anonymize(
    df: DataFrame,
    text_col: str = "text",
    mode: str = "replace",
    registry: Iterable[Recognizer] = DEFAULT_REGISTRY,
    threshold: float | None = None,
    config: EngineConfig = EngineConfig(),
    operators: Mapping[str, anonymizers.Operator] | None = None,
    default: anonymizers.Operator | None = None,
    mask_all: bool = False,
    extra: Iterable[Column] = (),
) -> DataFrame:
    """Replace, mask or redact the entities of a text column.

    Adds ``anonymized_text`` (``redacted_text`` when redacting), the raw ``entities`` as found before
    overlaps are settled, and ``operator_used``. The text and the previews are kept only with
    ``include_original``. ``operators`` overrides the operator of single entity types.
    """
    mode = mode.lower().strip()
    by_type, fallback = anonymizers.operators_for(mode, mask_all)
    choose = anonymizers.by_entity({**by_type, **(operators or {})}, default or fallback)
    text, registry, extra = F.col(text_col), tuple(registry), tuple(extra)
    if registry and not extra:
        limit = config.score_threshold if threshold is None else threshold
        cut = df.withColumn("_cut", recognizers.cut_at_entities(text, registry, limit))
        found = cut.withColumn(ENTITIES, F.col("_cut.spans"))
        rewritten = sp.rebuilt(F.col("_cut"), choose)
    else:
        found = analyze(df, text_col, registry, threshold, config, extra)
        rewritten = sp.replace_spans(text, F.col(ENTITIES), choose)
    name = "redacted_text" if mode == "redact" else "anonymized_text"
    out = found.withColumn(name, rewritten).withColumn("operator_used", F.lit(mode)).drop("_cut")
    if config.include_original:
        return out.withColumn("original_text", text).drop(text_col)
    return out.withColumn(ENTITIES, without_previews(F.col(ENTITIES))).drop(text_col)


def entity_rows(analyzed: DataFrame, *keep: str) -> DataFrame:
    """One row per entity."""
    return one_row_each(analyzed, ENTITIES, keep, "e").select(*keep, "e.*")


def entity_count(entities: Column) -> Column:
    return F.size(entities)


def entity_types(entities: Column) -> Column:
    """Distinct entity types of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["entity_type"])))


# Notes of the scan artifact.
SCAN_COMPLETED = "Scan completed."
SCAN_FAILED = "Scan failed. Enforcement controls still ran."
SCAN_UNAVAILABLE = "Scan unavailable: a required recognizer is not installed."


def scan(
    df: DataFrame,
    text_col: str,
    label: str,
    ignore_tokens: bool = False,
    registry: Iterable[Recognizer] = DEFAULT_REGISTRY,
    config: EngineConfig = EngineConfig(),
    available: bool = True,
    extra: Column | None = None,
    extra_status: Column | None = None,
) -> Column:
    """Scan artifact ``struct<label, status, entities, entity_count, note, scanned_text>``.

    A scan reports and never stops a row. ``ignore_tokens`` leaves out entities that overlap an
    encrypted token. ``extra`` are spans of a model and ``extra_status`` its status per row.
    """
    text = F.col(text_col)
    found = recognizers.analyze(
        text, registry, config.score_threshold, [] if extra is None else [extra]
    )
    if ignore_tokens:
        found = sp.outside(found, tokens.find_tokens(text))
    if not available:
        status = F.lit("unavailable")
    else:
        status = F.when(text.isNull(), "failed").otherwise("completed")
        if extra_status is not None:
            status = F.when(extra_status != "completed", extra_status).otherwise(status)
    done = status == "completed"
    entities = F.when(done, found).otherwise(sp.no_spans())
    if not config.include_original:
        entities = without_previews(entities)
    return F.struct(
        F.lit(label).alias("label"),
        status.alias("status"),
        entities.alias("entities"),
        F.when(done, F.lit(SCAN_COMPLETED))
        .when(status == "failed", F.lit(SCAN_FAILED))
        .otherwise(F.lit(SCAN_UNAVAILABLE))
        .alias("note"),
        (text if config.include_original else F.lit(None).cast("string")).alias("scanned_text"),
    )


def with_scan(df: DataFrame, name: str, text_col: str, label: str, **options) -> DataFrame:
    """Add a scan artifact column. The count is added last, so the entities are found once."""
    scanned = df.withColumn(name, scan(df, text_col, label, **options))
    return scanned.withColumn(name, F.col(name).withField("entity_count", F.size(f"{name}.entities")))


#: A word, with the sentence end behind it if there is one.
WORD_PATTERN = r"(?U)\w+(?:[.!?…]+['\"’”)\]]*(?=\s))?"


_PLAIN_WORD = r"(?U)\w+"

#: What stands behind a word, if it is a sentence end: the second half of WORD_PATTERN.
_STOP = r"(?U)^[.!?…]+['\"’”)\]]*\s"

_HIT = "struct<word:int,at:int,words:array<string>,stops:array<boolean>,entity_type:string>"


def _marked_words(text: Column) -> Column:
    """``array<struct<start, end, word, stop>>``: words in lower case, and whether a sentence end follows."""

    def marked(found: Column) -> Column:
        bare = F.regexp_extract(found["value"], _PLAIN_WORD, 0)
        return F.struct(
            found["start"].alias("start"),
            (found["start"] + F.length(bare)).alias("end"),
            F.lower(bare).alias("word"),
            (F.length(bare) < F.length(found["value"])).alias("stop"),
        )

    return F.transform(sp.find_spans(text, WORD_PATTERN), marked)


def _rarest_words(dictionary: DataFrame) -> DataFrame:
    """Each phrase once, with the word that fewest phrases hold (of those the longest, then the first) and its place."""
    words = _marked_words(F.col("phrase"))
    phrases = (
        dictionary.select(words.alias("w"), "entity_type")
        .where(F.size("w") > 0)
        .select(F.col("w.word").alias("words"), F.slice("w.stop", 1, F.size("w") - 1).alias("stops"), "entity_type")
        .distinct()
    )
    places = phrases.select("words", "stops", "entity_type", F.posexplode("words").alias("at", "word"))
    shared = phrases.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", -F.length("word"), "at")
    rarest = places.join(shared, "word").groupBy("words", "stops", "entity_type")
    return rarest.agg(F.min_by(F.struct("word", "at"), order).alias("rarest")).select("rarest.*", "words", "stops", "entity_type")


def dictionary_entities(
    df: DataFrame, key: str, text_col: str, dictionary: DataFrame, score: float = 0.85
) -> DataFrame:
    """Names and places from a ``(phrase, entity_type)`` table, one row per hit.

    An inverted index holds each phrase under its rarest word. The words of the texts meet the index in one equi-join, as single
    words with their places, so neither long phrases nor many lengths enlarge a row. Where an index word occurs, the phrase is
    compared with the text around it, and only there offsets are added up and sentence ends looked for. Spark broadcasts a small side of either join and shuffles large ones.

    Words end at Unicode word boundaries, in phrases and texts, and compare in lower case. They count as adjacent whatever
    stands between them, except for a sentence end that the phrase does not have there. The same hit of several spellings of a
    phrase is given once. Null texts have no hits. Texts that share a key, a null one too, have their hits each. Hits carry no preview.
    """
    index = _rarest_words(dictionary)
    words = F.posexplode(F.regexp_extract_all(text_col, F.lit(_PLAIN_WORD), F.lit(0))).alias("_place", "word")
    met = df.select(F.col(key).alias("_key"), words).withColumn("word", F.lower("word")).join(index, "word")
    hit = F.struct(F.col("_place").alias("word"), "at", "words", "stops", "entity_type").cast(_HIT)
    hits = met.groupBy("_key").agg(F.collect_set(hit).alias("_hits"))

    def holds(h: Column) -> Column:
        first, size = h["word"] - h["at"], F.size(h["words"])
        same = F.transform(F.slice("_w", first + 1, size), F.lower) == h["words"]
        stops = F.transform(F.slice("_gaps", first + 2, size - 1), lambda gap: gap.rlike(_STOP))
        return same & ((stops == h["stops"]) | ~F.exists(stops, lambda stop: stop))

    def span(h: Column) -> Column:
        first = h["word"] - h["at"]
        last = first + F.size(h["words"]) - 1
        start, end = (sp.sum_before(F.col("_steps"), F.col("_sums"), at) for at in (first, last + 1))
        return F.struct(h["entity_type"].alias("entity_type"), (start + F.length(F.get("_gaps", first))).alias("start"), end.alias("end"))

    texts = df.select(F.col(key), F.col(text_col).alias("_text"))
    joined = (
        texts.join(hits, texts[key].eqNullSafe(hits["_key"]))
        .select(
            key, "_hits", F.regexp_extract_all("_text", F.lit(_PLAIN_WORD), F.lit(0)).alias("_w"), F.split("_text", _PLAIN_WORD, -1).alias("_gaps")
        )
        .withColumn("_steps", F.zip_with(F.slice("_gaps", 1, F.size("_w")), "_w", lambda gap, word: F.length(gap) + F.length(word)))
        .withColumn("_sums", sp.block_sums(F.col("_steps")))
    )
    inside = F.filter("_hits", lambda h: (h["word"] >= h["at"]) & (h["word"] - h["at"] + F.size(h["words"]) <= F.size("_w")))
    spans = F.array_distinct(F.transform(F.filter(inside, holds), span))
    return joined.select(key, F.explode_outer(spans).alias("_s")).where(F.col("_s").isNotNull()).select(
        key,
        "_s.entity_type",
        "_s.start",
        "_s.end",
        F.lit(score).alias("score"),
        F.lit(None).cast("string").alias("text_preview"),
    )


def gather_spans(hits: DataFrame, key: str) -> DataFrame:
    """Hits of one text as a span array, to be passed to ``analyze(extra=...)`` after a join."""
    span = F.struct("entity_type", "start", "end", "score", "text_preview")
    return hits.groupBy(key).agg(F.collect_list(span).alias("dictionary_spans"))


def model_recognizer(load: Callable[[], Callable[[str], list[dict]]]) -> Callable[[Column], Column]:
    """Hook for a user's language model, as an Arrow-batched function.

    ``load`` runs once per Python worker and returns a function from text to a list of
    ``{entity_type, start, end, score}``. The result column is ``struct<status, spans>``; a text the
    model fails on gets status ``failed`` and no spans, and a model that does not load ``unavailable``.
    """
    result = f"struct<status:string,spans:{sp.SPANS_TYPE}>"

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            find = load()
        except Exception:
            find = None
        for texts in batches:
            rows = []
            for text in texts:
                if find is None:
                    rows.append(("unavailable", []))
                    continue
                try:
                    spans = [
                        {
                            "entity_type": s["entity_type"],
                            "start": int(s["start"]),
                            "end": int(s["end"]),
                            "score": round(float(s["score"]), 4),
                            "text_preview": text[s["start"] : s["end"]],
                        }
                        for s in (find(text) if text else [])
                    ]
                    rows.append(("completed", spans))
                except Exception:
                    rows.append(("failed", []))
            yield pd.DataFrame(rows, columns=["status", "spans"])

    return run
