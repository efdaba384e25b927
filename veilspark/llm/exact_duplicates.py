"""Exact duplicates by sorting content.

Rows are range-partitioned by their normalised text, sorted there by whole text and identifier, and each is compared
with its neighbour in full. Splitters come from Spark's sampling of the range key. That key is the beginning of the text and
a hash of all of it, so that splitters stay short and texts with a common beginning still spread; equality is decided
by the whole texts alone.

A text with more rows than an even share of a partition is sorted in several pieces; the first rows of these pieces are
then compared in the same way. There are at most twice as many pieces as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.llm.tables import partitions, whole, written

RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]

#: Characters of the text in the range key.
KEY_CHARACTERS = 32


def normalised(text: str | Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] | None = None
) -> DataFrame:
    """Each row's group of equal texts: `keep_id`, `group_size`, `kept` and `text_sha256`.

    Returns every row, with the identifier and the result columns, or with `columns` of the input and the result columns; an
    input column with the name of a result is left out. Null and empty texts are equal. Null identifiers come after
    all others; of rows that share the smallest identifier one is kept. An empty table gives an empty one.
    """
    columns = [c for c in (columns or [id_col]) if c not in RESULTS]
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        normalised(f"`{text_col}`").alias("norm"),
    )
    text_hash = F.xxhash64("norm").alias("hash")
    share = max(1, -(-df.count() // partitions(df)))
    hot = rows.groupBy(text_hash).count().where(F.col("count") > share)
    hot = hot.select("hash", F.ceil(F.col("count") / share).cast("int").alias("pieces"))

    # At most `partitions` texts have more rows than the even share, so this side is small at any size.
    keyed = rows.withColumn("hash", text_hash).join(F.broadcast(hot), "hash", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(0)).cast("int")
    keyed = keyed.select(
        "row", "id", "norm", F.substring("norm", 1, KEY_CHARACTERS).alias("start"), "hash", piece.alias("piece"),
        F.col("pieces").isNotNull().alias("split"),
    )
    ranged = keyed.repartitionByRange("start", "hash", "piece")
    equal = Window.partitionBy("start", "hash", "piece", "norm")
    in_order = equal.orderBy(F.col("id").asc_nulls_last())
    compared = ranged.select(
        "row", "id", "hash", "piece", "split", "norm",
        F.row_number().over(in_order).alias("place"),
        F.min("id").over(equal).alias("piece_keep"),
        F.count(F.lit(1)).over(equal).alias("piece_size"),
    )
    leads = F.col("split") & (F.col("place") == 1)
    compared = written(
        compared.select(
            "row", "id", "hash", "piece", "split", "place", "piece_keep", "piece_size",
            F.sha2("norm", 256).alias("text_sha256"), F.when(leads, F.col("norm")).alias("lead_text"),
        ),
        "exact-duplicates",
    )

    across = Window.partitionBy("hash", "lead_text")
    leaders = compared.where(leads).select(
        "hash", "piece", "piece_keep", "text_sha256",
        F.min("piece_keep").over(across).alias("keep"),
        F.sum("piece_size").over(across).alias("size"),
        F.row_number().over(across.orderBy(F.col("piece_keep").asc_nulls_last())).alias("nth_piece"),
    ).drop("lead_text")
    key = ["hash", "piece", "piece_keep", "text_sha256"]
    a, b = compared.alias("a"), F.broadcast(leaders).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    joined = a.join(b, same[0] & same[1] & same[2] & same[3] & F.col("a.split"), "left")
    return joined.select(
        "a.row.*",
        F.when(F.col("a.split"), F.col("b.keep")).otherwise(F.col("a.piece_keep")).alias("keep_id"),
        F.when(F.col("a.split"), F.col("b.size")).otherwise(F.col("a.piece_size")).alias("group_size"),
        ((F.col("a.place") == 1) & (~F.col("a.split") | (F.col("b.nth_piece") == 1))).alias("kept"),
        F.col("a.text_sha256").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", any_names: bool = False) -> DataFrame:
    """The input with the smallest identifier of each group of equal texts; the rest as `exact_duplicates`.

    Input columns named like a result raise, unless `any_names` lets them through unchanged.
    """
    if any_names:
        named = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
        marked = drop_exact_duplicates(named, f"c{df.columns.index(id_col)}", f"c{df.columns.index(text_col)}")
        return marked.toDF(*df.columns)
    if clash := set(df.columns) & set(RESULTS):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    marked = exact_duplicates(df, id_col, text_col, df.columns)
    return marked.where("kept").select(*(F.col(f"`{c}`") for c in df.columns))
