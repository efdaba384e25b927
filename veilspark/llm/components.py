"""Connected components of a table of links, by alternating large and small stars.

Each round replaces a node's links by links to the smallest node it knows; the components are found when nothing
changes. Every round is joins and minima, written to the shared folder, so nothing is gathered in one place and a lost
executor costs a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilspark.llm.tables import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, the smallest node it is linked to by any path, for links `a`, `b` of two longs.

    Nodes that are the smallest of their component, or without links, are not listed.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    while True:
        links = written(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
