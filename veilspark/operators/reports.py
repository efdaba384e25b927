"""Reports over tables: what was found, what would leak, what masking leaves visible."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilspark.functions import recognizers
from veilspark.functions.recognizers import DEFAULT_REGISTRY, Recognizer
from veilspark.operators import egress
from veilspark.operators.rows import one_row_each
from veilspark.sources.storage import shared_folder


def entity_profile(analyzed: DataFrame, doc_col: str, *by: str) -> DataFrame:
    """Entities and documents affected by entity type and the ``by`` columns, with totals.

    Entities are counted per document first, so the shuffle carries one row per document and type.
    The distinct count groups by document before it groups by type, which keeps a frequent type from
    landing in one task. Totals have null in the summed-over columns.
    """
    typed = one_row_each(analyzed, "entities.entity_type", (doc_col, *by), "entity_type")
    per_doc = typed.groupBy(doc_col, *by, "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.cube("entity_type", *by).agg(
        F.sum("n").alias("entities"), F.countDistinct(doc_col).alias("documents")
    )


def column_discovery(
    df: DataFrame, columns: Iterable[str] | None = None,
    registry: Iterable[Recognizer] = DEFAULT_REGISTRY, threshold: float = 0.35,
) -> DataFrame:
    """Share of the values of each string column that hold each entity type.

    Values become rows of ``(column, value)`` and are counted where they are read, so the tests of a value are compiled once, however
    many columns there are, and a task passes on one row for each column. Places and contexts are worked out only for recognizers
    whose score reaches the threshold by their context alone.
    """
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    value = F.col("c.value")
    held = recognizers.types_held(value, registry, threshold)
    cells = df.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names])).alias("c")
    ).where(value.isNotNull())
    counts = cells.groupBy(F.col("c.column").alias("column")).agg(
        F.count(F.lit(1)).alias("values"), *[F.count(F.when(test, 1)).alias(f"t{i}") for i, test in enumerate(held.values())]
    )
    by_type = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(f"t{i}").alias("n")) for i, t in enumerate(held)])
    listed = by_type if held else F.array().cast("array<struct<entity_type:string,n:bigint>>")
    return (
        counts.select("column", "values", F.explode(listed).alias("t"))
        .where(F.col("t.n") > 0)
        .select("column", "t.entity_type", "t.n", "values", (F.col("t.n") / F.col("values")).alias("share"))
    )


# Class suggested for a column in which an entity type is frequent.
SUGGESTED_CLASS = {"CREDIT_CARD": "PCI", "DATE_TIME": "INTERNAL", "URL": "INTERNAL"}


def suggest_classes(discovery: DataFrame, share: float = 0.5) -> DataFrame:
    """Columns in which some entity type reaches ``share``, with a class for them."""
    mapping = F.create_map(*[F.lit(p) for pair in SUGGESTED_CLASS.items() for p in pair])
    suggested = F.coalesce(F.try_element_at(mapping, F.col("entity_type")), F.lit("PII"))
    rank = F.when(suggested == "PCI", 3).when(suggested == "PII", 2).otherwise(1)
    return (
        discovery.where(F.col("share") >= share)
        .groupBy("column")
        .agg(F.max_by(suggested, rank).alias("classification"))
    )


def egress_audit(df: DataFrame, destination: str, **options) -> DataFrame:
    """Violations by path, class and rule. Array indexes are dropped from paths before counting."""
    listed = one_row_each(egress.report(df, destination, **options), egress.VIOLATIONS, (), "v")
    return (
        listed.select(
            F.regexp_replace("v.path", r"\[\d+\]", "[]").alias("path"), "v.classification", "v.rule"
        )
        .groupBy("path", "classification", "rule")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def frequency_leakage(plain: DataFrame, masked: DataFrame, column: str) -> DataFrame:
    """How many values occur how often, before and after masking.

    Deterministic masking keeps frequencies: where both counts agree, a reader can rank the masked
    values like the plain ones. Two aggregations with partial counts; no global ordering.
    """

    def profile(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))
        return counts.groupBy("frequency").agg(F.count(F.lit(1)).alias(name))

    joined = profile(plain, "plain_values").join(profile(masked, "masked_values"), "frequency", "full")
    return joined.select(
        "frequency",
        F.coalesce("plain_values", F.lit(0)).alias("plain_values"),
        F.coalesce("masked_values", F.lit(0)).alias("masked_values"),
    )


#: A value is indexed by a run of up to this many times the least length, so that longer values are told apart by more than a few digits.
_LONGEST_RUN = 8
#: Codes of index runs that may be sent to every task, whatever the number of values.
_CODES = 2**23


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` code points. The lookahead matches at every place, so each run is cut once from where it starts."""
    every = F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1))
    return F.array_distinct(F.filter(every, lambda g: F.length(g) == size))


def _rarest_grams(sought: DataFrame, minimum: int) -> DataFrame:
    """Each value with the size of the runs it is indexed by, and the run of that size that fewest values hold."""
    sizes = [minimum << k for k in range(_LONGEST_RUN.bit_length())]
    fitting = F.array_max(F.filter(F.array(*map(F.lit, sizes)), lambda z: z <= F.length("value")))
    sized = sought.withColumn("size", fitting)
    grams = sized.select("value", "size", F.explode(_grams(F.col("value"), F.col("size"))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return grams.join(shared, "gram").groupBy("value", "size").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def _gram_code() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(_CODES))


def corpus_leaks(
    texts: DataFrame, key: str, text_col: str, values: DataFrame, value_col: str, minimum: int = 5
) -> DataFrame:
    """Sensitive values that occur in any text, inside words too: ``(key, value)`` rows, values in lower case.

    The same rule as the leak check of single rows: a substring, whatever the case, of at least ``minimum`` characters. The index keeps
    each value under the run of its characters that fewest values share. Runs have one of four sizes, the longest that fits, so that
    many values of the same kind do not crowd under the same few digits. The distinct runs of each text first meet the codes of the
    indexed runs, a table of at most ``_CODES`` numbers that every task holds; only what is left meets the index in one equi-join, and
    only what met there is compared as a whole. No text is compared with every value. The index is written on the way.

    A value is given once for each text, and for each of several texts with the same key. Null texts, values and keys: a null text or
    value leaks nothing; texts with a null key are searched.
    """
    if minimum < 1:
        raise ValueError("a value must have at least one character")
    spark = texts.sparkSession
    lowered = F.lower(F.col(value_col).cast("string"))
    sought = values.select(lowered.alias("value")).where(F.length("value") >= minimum).distinct()
    path = shared_folder(spark, "leak-index")
    rarest = _rarest_grams(sought, minimum)
    rarest.write.parquet(path)
    index = spark.read.schema(rarest.schema).parquet(path)
    codes = index.select(_gram_code().alias("_code")).distinct()
    sizes = index.agg(F.collect_set("size")).scalar()  # at most four
    own = texts.select(F.col(key).alias("_key"), F.lower(text_col).alias("_text"), sizes.alias("_sizes"))
    runs = F.flatten(F.transform("_sizes", lambda size: _grams(F.col("_text"), size)))
    held = own.select("_key", F.explode(runs).alias("gram"))
    likely = held.join(F.broadcast(codes), _gram_code() == F.col("_code"), "left_semi")
    met = likely.join(index.select("gram", "value"), "gram")
    candidates = met.groupBy("_key").agg(F.collect_set("value").alias("_values"))
    searched = texts.select(F.col(key), F.lower(text_col).alias("_text"))
    joined = searched.join(candidates, searched[key].eqNullSafe(candidates["_key"]))
    leaked = F.filter("_values", lambda v: F.contains(F.col("_text"), v))
    return joined.select(key, F.explode_outer(leaked).alias("value")).where(F.col("value").isNotNull())
