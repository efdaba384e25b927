"""Shards of bounded size by extendible hashing.

A row's place is a hash of its identifier. The directory starts with all rows in one bucket; a bucket over the limit is split on
the next bit of the hash, and only that bucket. A row's shard is the shortest prefix of its hash whose rows fit the limit.

The directory is worked out on the sizes of cells, some bits deeper than an even spread needs, and not on the rows. Cells that
are still too large are cut deeper with their rows alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.llm.tables import whole, written

RESULTS = ["n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]

BITS = 60

#: Bits of a cell beyond those that an even spread needs.
SPARE_BITS = 3


def place(id_col: str | Column) -> Column:
    """The first bits of a checksum of the identifier as text; a null identifier counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(column: str, depth: int | Column) -> Column:
    """The first `depth` bits."""
    return F.call_function("shiftright", F.col(column), (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, top: int, bottom: int, limit: int) -> DataFrame:
    """For each cell of `bottom` bits the shallowest prefix, of at least `top` bits, that fits; null where none does."""
    shift = F.call_function("shiftright", F.col("cell"), (F.lit(bottom) - F.col("depth")).cast("int"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(bottom)))).withColumn("prefix", shift)
    sizes = levels.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    fits = (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))
    fitting = levels.select("cell", "depth", "prefix").join(sizes.where(fits).select("depth", "prefix", "bytes", "rows"), ["depth", "prefix"])
    leaf = F.min_by(F.struct("depth", "prefix", "bytes", "rows"), "depth").alias("leaf")
    return cells.select("cell").join(fitting.groupBy("cell").agg(leaf), "cell", "left")


def shards(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's identifier with `n_bytes`, its `shard` (the bits of its bucket after a "b"), its `depth` (how many bits), and the
    shard's `shard_bytes` and `shard_rows`.

    Every shard has at most `limit` bytes of text (UTF-8; null: none), except one that cannot be split: a single larger text, or
    rows with the same identifier. An empty table gives an empty one.
    """
    if limit < 1:
        raise ValueError("a shard must hold at least one byte")
    rows = written(
        df.select(F.col(f"`{id_col}`").alias("id"), place(f"`{id_col}`").alias("place"), F.octet_length(whole(f"`{text_col}`")).cast("bigint").alias("bytes")),
        "sizes",
    )
    top, done, left = 0, [], rows
    largest = rows.agg(F.sum("bytes")).first()[0] or 0
    while True:
        bottom = min(BITS, top + max(0, math.ceil(math.log2(max(1, largest / limit)))) + SPARE_BITS)
        keyed = left.withColumn("cell", _prefix("place", bottom))
        cells = keyed.groupBy("cell").agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        cells = written(cells, "cells")
        leaves = written(_leaves(cells, top, bottom, limit), "leaves")
        found = keyed.join(leaves.where("leaf is not null"), "cell")
        done.append(found.select("id", "bytes", "leaf"))
        open_ = leaves.where("leaf is null").select("cell")
        largest = cells.join(open_, "cell").agg(F.max("bytes")).first()[0]
        if largest is None:
            break
        left = written(keyed.join(open_, "cell", "left_semi").drop("cell"), "sizes")
        top = bottom
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    bits = F.when(F.col("leaf.depth") > 0, F.lpad(F.bin("leaf.prefix"), F.col("leaf.depth"), F.lit("0"))).otherwise("")
    return out.select(
        F.col("id").alias(id_col),
        F.col("bytes").alias("n_bytes"),
        F.concat(F.lit("b"), bits).alias("shard"),
        F.col("leaf.depth").cast("int").alias("depth"),
        F.col("leaf.bytes").alias("shard_bytes"),
        F.col("leaf.rows").alias("shard_rows"),
    )


def write_shards(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows to `path`, one folder for each shard. A column `shard` of the input is replaced."""
    found = shards(df, limit, id_col, text_col).select(F.col(f"`{id_col}`").alias("_shard_id"), "shard").distinct()
    rows = df.drop("shard").join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("_shard_id"))).drop("_shard_id")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
