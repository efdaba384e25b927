"""How far the sources of a language differ in their words, term by term and source by source.

A term's row lists the sources it occurs in, in the order of the sources, each with its count. Two sources differ over all kept terms
by the sum of |p - q|. A source's p of a term it lacks is one constant, so most of the sum needs no look at single terms:

1. Terms that neither source has differ by the same constant; so the sum starts from (kept terms) x (that constant).
2. Terms that a source has are corrected against the other source's constant. These corrections depend on the source's own
   p and the other's constant only, and follow from running sums over the source's distinct p in order.
3. Terms that both have are corrected once more. Equal rows are counted, and the distinct rows with their multiplicities form a
   frequent-pattern tree: rows that begin with the same sources and counts share a path. Every node is met with each of its
   ancestors once, with the multiplicity of all rows that pass through it.

Rows come to the tasks in their order, ranges of neighbouring rows to each, so a task walks its part of the tree depth first and
holds one path at a time; a node that lies on the border of two tasks is met in both, with the rows of each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.llm.tables import whole, written

SCALE, PRIOR, LEAST_DOCUMENTS, TOP_TERMS = 1_000_000_000, 5, 30, 50

#: Terms with counts that a task holds before it hands them on.
HELD_TERMS = 300_000

#: Sums of pairs that a task holds before it hands them on.
HELD_PAIRS = 1_000_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = "lang string, source string, term binary, docs bigint, n bigint"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, and each such group once with the empty term."""
    counts: dict[tuple, list[Counter]] = {}
    size = 0

    def held() -> pa.RecordBatch:
        rows = [(*group, term, docs[term], n) for group, (docs, occurrences) in counts.items() for term, n in occurrences.items()]
        columns = zip(*rows) if rows else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "docs", "n"])

    for batch in batches:
        for text, *group in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
            docs, occurrences = counts.setdefault(tuple(group), [Counter(), Counter()])
            found = _TERM.findall(text.lower())
            size -= len(occurrences)
            occurrences.update(found)
            docs.update(set(found))
            occurrences[b""] += 0
            size += len(occurrences)
            if size > HELD_TERMS:
                yield held()
                counts, size = {}, 0
    if counts:
        yield held()


def _term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    texts = df.select(
        whole(f"`{text_col}`").cast("binary").alias("text"),
        whole(F.col(f"`{lang_col}`").cast("string")).alias("lang"),
        whole(F.col(f"`{source_col}`").cast("string")).alias("source"),
    )
    counts = texts.mapInArrow(_count_terms, _COUNTS).groupBy("lang", "source", "term")
    return counts.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _probability(n: str | Column, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), in decimals of 38 digits; 0 where no term is kept."""
    column = F.col(n) if isinstance(n, str) else n
    above = (column.cast("decimal(20,0)") + PRIOR).cast("decimal(21,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (F.col(total).cast("decimal(20,0)") + F.col(kept).cast("decimal(18,0)") * PRIOR).cast("decimal(24,0)")
    return F.when(below > 0, F.call_function("div", above, below) + 1).otherwise(F.lit(0).cast("bigint"))


class _PairSums:
    """Sums for pairs of sources of one language: for each later source an array over the earlier ones."""

    def __init__(self, lang: str):
        self.lang, self.held, self._rows = lang, 0, {}

    def add(self, source: int, earlier: np.ndarray, values: np.ndarray) -> None:
        row = self._rows.get(source)
        if row is None:
            self._rows[source] = row = np.zeros(source, np.int64)
            self.held += source
        row[earlier] += values

    def batch(self) -> pa.RecordBatch:
        parts = [(np.full(len(own), source), own, row[own]) for source, row in self._rows.items() for own in [np.flatnonzero(row)]]
        later, earlier, value = (np.concatenate(c) for c in zip(*parts)) if parts else ([], [], [])
        columns = [pa.array([self.lang] * len(later), pa.string()), *(pa.array(c, k) for c, k in ((earlier, pa.int32()), (later, pa.int32()), (value, pa.int64())))]
        self.__init__(self.lang)
        return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])


class _Path:
    """The path of the tree from the root to the current node: source, p, constant and multiplicity of each node."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self.times: list[int] = []

    def leave(self, depth: int, sums: _PairSums) -> None:
        """Steps back to `depth`; each node left behind is met with its ancestors, and its rows count for its parent too."""
        while len(self.nodes) > depth:
            source, p, z = self.nodes.pop()
            times = self.times.pop()
            if self.nodes:
                self.times[-1] += times
                above, q, y = np.array(self.nodes, np.int64).T
                both = np.abs(q - p) - np.abs(q - z) - np.abs(y - p) + np.abs(y - z)
                sums.add(source, above, times * both)


def _meet_in_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of sources from rows in their order: `lang`, `row` (source, p and z of each entry) and `times`."""
    path, sums = _Path(), _PairSums("")
    for batch in batches:
        rows = batch.column("row")
        at, entries = rows.offsets.to_numpy(), rows.values
        source, p, z = (entries.field(c).to_numpy().tolist() for c in ("source", "p", "z"))
        for i, (lang, times) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist())):
            row = list(zip(source[at[i] : at[i + 1]], p[at[i] : at[i + 1]], z[at[i] : at[i + 1]]))
            if lang != sums.lang:
                path.leave(0, sums)
                yield sums.batch()
                sums = _PairSums(lang)
            common = 0
            while common < min(len(row), len(path.nodes)) and row[common] == path.nodes[common]:
                common += 1
            path.leave(common, sums)
            for node in row[common:]:
                path.nodes.append(node)
                path.times.append(0)
            path.times[-1] += times
            if sums.held > HELD_PAIRS:
                yield sums.batch()
    path.leave(0, sums)
    yield sums.batch()


def _numbered(groups: DataFrame) -> DataFrame:
    """Sources of each language numbered from 0 in their order."""
    return groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def _own_corrections(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """For each ordered pair of sources: what the terms of the first add to (kept terms) x |z - other z|.

    A term's p is never below its source's constant z. Against another constant at or below z each term adds p - z; against a greater
    one y it adds z - p up to y and p + z - 2y beyond it.
    """
    counted = entries.groupBy("lang", "number", "p").agg(F.count(F.lit(1)).alias("times"))
    others = groups.select("lang", F.col("number").alias("other"), F.col("z").alias("y"))
    pairs = groups.select("lang", "number", "z").join(others, "lang").where("number <> other")
    none = F.lit(None)
    points = counted.select("lang", "number", F.col("p").alias("at"), "times", none.cast("int").alias("other"), none.cast("bigint").alias("z")).unionAll(
        pairs.select("lang", "number", F.col("y").alias("at"), F.lit(0).cast("bigint").alias("times"), "other", "z")
    )
    own = Window.partitionBy("lang", "number")
    beyond = own.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("times") * F.col("at")
    summed = points.select(
        "lang", "number", "other", "z", F.col("at").alias("y"),
        F.sum("times").over(own).alias("n"), F.sum(weight).over(own).alias("sum"),
        F.sum("times").over(beyond).alias("n_beyond"), F.sum(weight).over(beyond).alias("sum_beyond"),
    ).where("other is not null")
    split = F.expr("sum_beyond + n_beyond * (z - 2 * y) + (n - n_beyond) * z - (sum - sum_beyond)")
    value = F.when(F.col("y") <= F.col("z"), F.col("sum") - F.col("n") * F.col("z")).otherwise(split)
    return summed.select("lang", F.least("number", "other").alias("a"), F.greatest("number", "other").alias("b"), value.alias("value"))


def source_divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """Rows `lang`, `source`, `part`, `item`, `value`, `rank`.

    Terms are runs of letters (A-Z lower-cased) and characters beyond ASCII; a language keeps those in at least `least_documents` of
    its rows. A source's p of a kept term is 1 + floor(10^9 (count + 5) / (N + 5 V)) with N its occurrences of the V kept terms.

    `pair` lists every other source of the language by the sum of |p - q| over all kept terms. `term` lists the kept terms that the
    source has, and has more often than the language as a whole (q), by p - q, down to rank `top_terms`. Ranks go by falling value,
    ties by rising item in the order of UTF-8 bytes.

    Null text, lang and source count as empty texts; every row is a document, repeated ones too. A source without terms takes part;
    a language without kept terms has pairs of value 0; an empty table gives an empty one. Sums are exact as long as the number of
    kept terms of a language stays below nine billion. A term's row is as long as its language has sources, and the result holds all
    pairs of them.
    """
    counts = written(_term_counts(df, text_col, lang_col, source_col), "term-counts")
    found = counts.where(F.octet_length("term") > 0)
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_documents)
    entries = written(found.join(kept.select("lang", "term", "lang_n"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    groups = counts.where(F.octet_length("term") == 0).select("lang", "source")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = entries.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang")
    terms = terms.agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    groups = _numbered(groups).join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", "number", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total", "kept", "lang_total")))
    groups = written(groups.withColumn("z", _probability(F.lit(0), "total", "kept")), "sources")

    scored = entries.join(groups, ["lang", "source"]).withColumn("p", _probability("n", "total", "kept"))
    scored = written(scored.withColumn("q", _probability("lang_n", "lang_total", "kept")), "scored-terms")

    row = F.sort_array(F.collect_list(F.struct(F.col("number").alias("source"), "p", "z"))).alias("row")
    rows = scored.groupBy("lang", "term").agg(row).groupBy("lang", "row").agg(F.count(F.lit(1)).alias("times"))
    rows = written(rows, "term-rows").repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    met = rows.mapInArrow(_meet_in_tree, "lang string, a int, b int, value bigint")

    left = groups.select("lang", F.col("number").alias("a"), F.col("z").alias("x"), "kept")
    right = groups.select("lang", F.col("number").alias("b"), F.col("z").alias("y"))
    start = left.join(right, "lang").where("a < b").select("lang", "a", "b", (F.col("kept") * F.abs(F.col("x") - F.col("y"))).alias("value"))
    sums = start.unionAll(_own_corrections(scored.select("lang", "number", "p"), groups)).unionAll(met)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionAll(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", F.col("number").alias("a"), "source")
    items = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    pairs = both.join(names, ["lang", "a"]).join(items, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    exceeding = scored.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    ranking = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = exceeding.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(ranking)).unionAll(ranked)
