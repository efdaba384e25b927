"""Near duplicates by one-permutation MinHash with optimal densification.

1. Each text becomes a set of hashed word shingles, one hash of it per bin (the smallest that falls there), an empty bin
   borrowing from the first non-empty one of its own probing sequence. Runs of bins are bands; documents that agree on a
   band share a bucket.
2. Documents with the same set are one class from here on. Each bucket proposes links from one centre, its member with the
   fullest buckets, to the others: a star, not all pairs.
3. Every proposed link is confirmed on the full sets, and linked classes are joined to components.
4. A star alone would miss a link between two members when the centre resembles one of them too little. Both are known by what
   they differ from the centre in, and the difference of two members is the difference of these two differences. So a member
   that the centre resembles too little can be linked only with one that shares much of its difference. Such pairs are found
   by a join on the rarest elements of the differences, as many as the bound requires, and confirmed like the others. Nothing is
   capped.

The chance of no common bucket is (1 - s^rows)^bands for similarity s: about 3 in a million at 0.8 with the defaults, and less
above.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.llm import text_bytes as tb
from veilspark.llm.components import components
from veilspark.llm.tables import whole, written

RESULTS = ["n_shingles", "component_id", "kept"]

BANDS, ROWS = 32, 5

_PRINTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x71D67FFFEDA60000))
_SIGNED = "struct<n:bigint,print_1:bigint,print_2:bigint,keys:array<bigint>>"


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's texts, sorted by text and hash, and where each text's begin."""
    found = tb.Words(data, offsets, tb.NOT_SPACE)
    hashes, starts = tb.windows(found, words)
    texts = found.texts()[starts]
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    hashes, texts = hashes[first], texts[first]
    return hashes, np.searchsorted(texts, np.arange(len(offsets)))


def _bins(hashes: np.ndarray, texts: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """The smallest hash in each bin of each text; empty bins borrow."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    lead = np.ones(len(hashes), bool)
    lead[1:] = (at[1:] != at[:-1]) | (texts[1:] != texts[:-1])
    own = np.zeros((rows, bins), np.uint64)
    filled = np.zeros((rows, bins), bool)
    own[texts[lead], at[lead].astype(np.int64)] = hashes[lead]
    filled[texts[lead], at[lead].astype(np.int64)] = True
    out = own.copy()
    text, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(text):
        probe = tb.mixed(np.arange(bins, dtype=np.uint64) + np.uint64(1 + attempt * bins)) % np.uint64(bins)
        lender = probe[empty].astype(np.int64)
        found = filled[text, lender]
        out[text[found], empty[found]] = own[text[found], lender[found]]
        text, empty = text[~found], empty[~found]
        attempt += 1
    return out


def _signatures(words: int, bands: int, rows: int) -> Callable[[pa.Array], pa.Array]:
    def signatures(text: pa.Array) -> pa.Array:
        data, offsets = tb.flat(text)
        parts = []
        for i, j in tb.blocks(offsets):
            hashes, at = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            counts = np.diff(at)
            prints = []
            for seed in _PRINTS:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mixed(hashes ^ seed))])
                prints.append(sums[at[1:]] - sums[at[:-1]])
            values = _bins(hashes, np.repeat(np.arange(j - i), counts), j - i, bands * rows)
            keys = np.stack([tb.chained_columns(values[:, b * rows : (b + 1) * rows], b) for b in range(bands)], 1)
            parts.append((counts, *prints, keys))
        if not parts:
            return pa.array([], pa.struct([("n", pa.int64()), ("print_1", pa.int64()), ("print_2", pa.int64()), ("keys", pa.list_(pa.int64()))]))
        n, one, two, keys = (np.concatenate(x) for x in zip(*parts))
        some = n > 0
        ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1).view(np.int64)))
        fields = [pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists]
        return pa.StructArray.from_arrays(fields, ["n", "print_1", "print_2", "keys"])

    return signatures


def _shingles(words: int) -> Callable[[pa.Array], pa.Array]:
    def shingles(text: pa.Array) -> pa.Array:
        data, offsets = tb.flat(text)
        values, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for i, j in tb.blocks(offsets):
            hashes, at = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            values.append(hashes)
            ends.append(at[1:] + ends[-1][-1])
        at = pa.array(np.concatenate(ends).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.array(np.concatenate(values).view(np.int64)))

    return shingles


def _stars(placed: DataFrame) -> DataFrame:
    """Pairs `a`, `b` of a centre and another member of a bucket."""
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(placed.join(sizes, "key"), "buckets")
    fullness = members.groupBy("node").agg(F.sum("size").alias("fullness"))
    centres = members.join(fullness, "node").groupBy("key").agg(F.max(F.struct("fullness", "node"))["node"].alias("centre"))
    pairs = members.join(centres, "key").where("node <> centre")
    return written(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs `a`, `b` with their sets."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return with_b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")


def _alike(difference: Column, sizes: Column, percent: int) -> Column:
    """Whether sets of so many elements together that differ in so many are similar enough."""
    return (100 + percent) * difference <= (100 - percent) * sizes


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b` with the sizes of their sets, the elements that only one of them has, and whether they are linked."""
    difference = F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a"))
    both = _with_sets(pairs, sets).select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), difference.alias("difference"))
    return both.withColumn("linked", _alike(F.size("difference"), F.col("n_a") + F.col("n_b"), percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b` whose sets are similar enough."""
    both = _with_sets(pairs, sets)
    sizes = F.size("set_a") + F.size("set_b")
    return both.where(_alike(sizes - 2 * F.size(F.array_intersect("set_a", "set_b")), sizes, percent)).select("a", "b")


def _beside_centre(compared: DataFrame, percent: int) -> DataFrame:
    """Pairs `a`, `b` of members of a star that may be linked although the centre is not linked with one of them.

    For members x and y of a star, with differences X and Y from the centre, the sets differ in |X| + |Y| - 2 |X and Y|. If the
    centre is not linked with x, a link of x and y needs more than half of |Y| + r (centre - y) in common, where r is
    (100 - percent) / (100 + percent). So it has one among the first of Y in any order, as many as the rest leaves.
    """
    stars = compared.groupBy("a").agg(F.count(F.lit(1)).alias("members"), F.min("linked").alias("all_linked"))
    stars = stars.where("members > 1 and not all_linked").select("a")
    inner = compared.join(stars, "a").withColumn("n", F.size("difference"))
    elements = written(inner.select("a", "b", "n_a", "n_b", "n", "linked", F.explode("difference").alias("element")), "differences")
    counts = elements.groupBy("a", "element").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = elements.join(counts, ["a", "element"])
    # An element that no other member of the star has comes before all shared ones.
    own = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("a", "b"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "element")) + own
    ordered = written(shared.withColumn("place", place), "ordered-differences")

    least = F.floor(((100 + percent) * F.col("n") + (100 - percent) * (F.col("n_a") - F.col("n_b"))) / (2 * (100 + percent))) + 1
    y = ordered.where(F.col("place") <= F.col("n") - least + 1).alias("y")
    x = ordered.where("not linked").alias("x")
    common = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    needed = (100 + percent) * (F.col("x.n") + F.col("y.n")) - (100 - percent) * (F.col("x.n_b") + F.col("y.n_b"))
    meet = (F.col("x.a") == F.col("y.a")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.b") != F.col("y.b"))
    pairs = x.join(y, meet & (2 * (100 + percent) * common >= needed))
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Each row's `n_shingles`, `component_id` (the smallest identifier reachable by links) and `kept` (it is the smallest).

    A set is a text's distinct runs of `words` words, after lower-casing A-Z; a text of fewer words is one run, and a
    text without words or a null one has none and is linked with nothing. Two sets are linked if their intersection is
    at least `percent` per cent of their union. Repeated rows are linked like others; rows that share the smallest
    identifier are all kept. Null identifiers are smaller than none: a component has one only if all its identifiers are null.
    Returns the identifier and the result columns; other columns are not read.
    """
    signed = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(whole(f"`{text_col}`")).alias("text_hash"),
        F.arrow_udf(_signatures(words, bands, rows), _SIGNED)(whole(f"`{text_col}`")).alias("s"),
    )
    signed = written(signed.select("id", "text_hash", "s.*"), "signatures")

    prints = ["print_1", "print_2"]
    classes = signed.where("n > 0").groupBy(*prints).agg(
        F.min("id").alias("least_id"),
        F.min(F.struct("id", "text_hash")).alias("example"),
        F.first("keys").alias("keys"),
    )
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")

    placed = classes.select("node", F.explode("keys").alias("key"))
    pairs = _stars(placed)

    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", "example", *prints)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), whole(f"`{text_col}`").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    same = (texts["text_hash"] == F.col("example.text_hash")) & texts["id"].eqNullSafe(F.col("example.id"))
    sets = texts.join(used, same).select("node", F.arrow_udf(_shingles(words), "array<bigint>")("text").alias("set"))
    sets = written(sets, "shingle-sets")

    compared = written(_compared(pairs, sets, percent), "compared")
    more = written(_beside_centre(compared, percent), "pairs")
    labels = components(compared.where("linked").select("a", "b").unionAll(_confirmed(more, sets, percent)))

    labelled = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    smallest = labelled.join(least, "component").select(*prints, "component_id")
    out = signed.select("id", "n", *prints).join(smallest, prints, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input with the row of the smallest identifier of each component; the rest as `near_duplicates`."""
    kept = near_duplicates(df, id_col, text_col, **parameters).where("kept")
    kept = kept.select(F.col(f"`{id_col}`").alias("_kept_id")).distinct()
    return df.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("_kept_id")), "left_semi")
