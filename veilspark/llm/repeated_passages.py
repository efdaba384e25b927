"""Passages that repeat anywhere in the corpus, found by sorting suffixes column by column.

A collection's suffixes can be sorted in rounds: each inserts the next symbol to the left of every document and brings the order of
the suffixes (the Burrows-Wheeler transform) and their common prefixes up to date. Done on whole documents the rounds are as
many as the longest has bytes, and each rewrites the order of all suffixes so far. Here the rounds are bounded:

1. Every window of LENGTH bytes has an anchor, the run of GRAM bytes in it whose hash comes first. Equal windows have equal
   anchors at equal places. The windows of one anchor are a piece: some hundred bytes of text, aligned at the anchor.
2. Pieces are keyed by the bytes that all windows of their cell (a range of distances to the anchor) have in common. Only
   keys that occur more than once go on. Pieces that are equal throughout are one class, and their windows repeat.
3. The classes of a key are sorted together, column by column from the right: one symbol of each piece per round, the
   order by a stable sort, the common prefixes by the minimum over the rows between new neighbours. A window repeats if the suffix at
   its start shares LENGTH bytes with a neighbour.
4. A key with more than GROUP classes is cut into cells of half the width, whose common bytes are longer, as often as needed; a
   cell of width one is a window, whose key is the window itself.

Bytes covered by repeating windows are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilspark.llm import text_bytes as tb
from veilspark.llm.tables import whole, written

LENGTH, GRAM = 400, 64

#: Distances from a window's start to its anchor, and the width of the first cells.
REACH = LENGTH - GRAM + 1
CELL = (REACH + 1) // 2

#: One gram in so many may be an anchor, where a window has such a gram.
SAMPLED = 16

#: Classes of a key that one task sorts together.
GROUP = 8192

_PIECE = "struct<key:bigint,content:bigint,start:int,windows:int,reach:int,cell:int,width:int>"
_NAMES = ["key", "content", "start", "windows", "reach", "cell", "width"]


def _limit(places: np.ndarray, ranks: np.ndarray, forward: bool) -> np.ndarray:
    """The nearest place after (before) each that has a smaller (no greater) rank, if within reach; else one far away."""
    size = len(places)
    far = np.int64(1) << 60
    out = np.full(size, far if forward else -far)
    active, step = np.arange(size), 1
    while len(active):
        other = active + step if forward else active - step
        inside = (other >= 0) & (other < size)
        active, other = active[inside], other[inside]
        near = np.abs(places[other] - places[active]) < REACH
        active, other = active[near], other[near]
        found = ranks[other] < ranks[active] if forward else ranks[other] <= ranks[active]
        out[active[found]] = places[other[found]]
        active, step = active[~found], step + 1
    return out


def _anchored(data: np.ndarray, offsets: np.ndarray, hashes: tb.RangeHash) -> tuple[np.ndarray, ...]:
    """Anchors of a block's texts: place, first and last window, and text."""
    ranks = hashes.every(GRAM)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(ranks)]
    fits = (np.arange(len(ranks)) + GRAM <= offsets[1:][text]) & (sizes >= LENGTH)[text]
    common = (ranks % np.uint64(SAMPLED)) == 0
    ranks = (ranks >> np.uint64(1)) | (~common).astype(np.uint64) << np.uint64(63)
    # Where a window may have no sampled gram, all grams count; a gap in the samples there is as long as a window.
    sampled = np.flatnonzero(common & fits)
    cuts = np.searchsorted(sampled, offsets)
    for t in np.flatnonzero(sizes >= LENGTH):
        own = np.concatenate([[offsets[t] - 1], sampled[cuts[t] : cuts[t + 1]], [offsets[t + 1] - GRAM + 1]])
        for gap in np.flatnonzero(np.diff(own) > REACH):
            common[own[gap] + 1 : own[gap + 1]] = True
    places = np.flatnonzero(common & fits)
    ranks, text = ranks[places], text[places]
    first = np.maximum(np.maximum(places - REACH + 1, _limit(places, ranks, False) + 1), offsets[text])
    last = np.minimum(np.minimum(places, _limit(places, ranks, True) - REACH), offsets[text + 1] - LENGTH)
    some = first <= last
    return places[some], first[some], last[some], text[some]


def _keyed(hashes: tb.RangeHash, contents: tb.RangeHash, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, cell: np.ndarray, width: np.ndarray):
    """Keys and contents of the windows first..last, whose distances to the anchor are cell..cell+width-1."""
    geometry = (cell << 20 | width << 10).astype(np.uint64)
    key = tb.mixed(hashes(anchor - cell, anchor - cell - width + 1 + LENGTH) ^ geometry)
    shape = ((anchor - first) << 10 | (last - first)).astype(np.uint64)
    return key.view(np.int64), tb.mixed(contents(first, last + LENGTH) ^ shape).view(np.int64)


def _cut(anchor: np.ndarray, first: np.ndarray, last: np.ndarray, cell: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows of each row that fall into a cell: row, first, last."""
    first, last = np.maximum(first, anchor - cell - width + 1), np.minimum(last, anchor - cell)
    rows = np.flatnonzero(first <= last)
    return rows, first[rows], last[rows]


def _lists(owners: np.ndarray, rows: int, columns: list[np.ndarray]) -> pa.Array:
    order = np.argsort(owners, kind="stable")
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
    values = pa.StructArray.from_arrays([pa.array(c[order]).cast(k) for c, k in zip(columns, kinds)], _NAMES)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners[order], np.arange(rows + 1)).astype(np.int32)), values)


def _pieces(text: pa.Array) -> pa.Array:
    """The pieces of each text; `start` counts from the text's first byte, `reach` from the piece's first to the anchor."""
    data, offsets = tb.flat(text)
    parts = [(np.zeros(0, np.int64),) * 8]
    for i, j in tb.blocks(offsets, tb.BLOCK_BYTES // 2):
        block, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, contents = tb.RangeHash(block), tb.RangeHash(block, tb.BASES[1])
        anchor, first, last, of = _anchored(block, own, hashes)
        for low, high in ((0, CELL), (CELL, REACH)):
            cell, width = np.full(len(anchor), low), np.full(len(anchor), high - low)
            rows, a, b = _cut(anchor, first, last, cell, width)
            place, cell, width = anchor[rows], cell[rows], width[rows]
            key, content = _keyed(hashes, contents, place, a, b, cell, width)
            parts.append((of[rows] + i, key, content, a - own[of[rows]], b - a + 1, place - a, cell, width))
    owners, *columns = (np.concatenate(x) for x in zip(*parts))
    return _lists(owners, len(text), columns)


def _halves(piece: pa.Array, reach: pa.Array, windows: pa.Array, cell: pa.Array, width: pa.Array) -> pa.Array:
    """Pieces cut into cells of half the width; `start` counts from the piece's first byte."""
    data, offsets = tb.flat(piece)
    reach, windows, cell, width = (x.to_numpy().astype(np.int64) for x in (reach, windows, cell, width))
    parts = [(np.zeros(0, np.int64),) * 8]
    for i, j in tb.blocks(offsets):
        block, first = data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        hashes, contents = tb.RangeHash(block), tb.RangeHash(block, tb.BASES[1])
        anchor, last, half = first + reach[i:j], first + windows[i:j] - 1, (width[i:j] + 1) // 2
        for low, size in ((cell[i:j], half), (cell[i:j] + half, width[i:j] - half)):
            rows, a, b = _cut(anchor, first, last, low, size)
            place = anchor[rows]
            key, content = _keyed(hashes, contents, place, a, b, low[rows], size[rows])
            parts.append((rows + i, key, content, a - first[rows], b - a + 1, place - a, low[rows], size[rows]))
    owners, *columns = (np.concatenate(x) for x in zip(*parts))
    return _lists(owners, len(piece), columns)


def _offsets(ends: np.ndarray) -> pa.Buffer:
    """Offsets of a binary column; a batch of over 2 GB fails instead of wrapping around."""
    if ends[-1] >= 1 << 31:
        raise OverflowError("a batch of texts has over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.py_buffer(ends.astype(np.int32))


def _slices(text: pa.Array, pieces: pa.Array) -> pa.Array:
    """The bytes of pieces of each text, given as start and windows."""
    data, offsets = tb.flat(text)
    at = pieces.offsets.to_numpy()
    flat = pieces.flatten()
    starts = flat.field("start").to_numpy().astype(np.int64) + np.repeat(offsets[:-1], np.diff(at))
    sizes = flat.field("windows").to_numpy().astype(np.int64) + LENGTH - 1
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.uint8)
    for a, size, b in zip(starts, sizes, ends):
        out[b - size : b] = data[a : a + size]
    bounds = _offsets(np.concatenate([[0], ends]))
    values = pa.Array.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(out)])
    return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), values)


def repeating(groups: np.ndarray, columns: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which columns of which rows start a string of `length` symbols that another row of the group has at the same columns.

    Rows come in the order of their groups; a symbol of 0 is none. A row's strings start at `first` and the columns after, `windows`
    in all.
    """
    rows, size = columns.shape
    out = np.zeros((rows, size), bool)
    order, common = np.arange(rows), np.zeros(rows + 1, np.int64)
    by_column = np.ascontiguousarray(columns.T)
    for c in range(size - 1, -1, -1):
        symbols = by_column[c][order]
        sort_key = groups[order] * 257 + symbols
        if (sort_key[1:] < sort_key[:-1]).any():
            moved = np.argsort(sort_key, kind="stable")
            order, sort_key, symbols = order[moved], sort_key[moved], symbols[moved]
            between = np.stack([moved[:-1] + 1, moved[1:] + 1], 1)
            same = between[:, 0] < between[:, 1]
            least = np.zeros(rows - 1, np.int64)
            near = between[same]
            if len(near):
                least[same] = np.minimum.reduceat(common, near.reshape(-1))[::2]
            common[1:rows] = least
        alike = (sort_key[1:] == sort_key[:-1]) & (symbols[1:] > 0)
        common[1:rows] = np.where(alike, common[1:rows] + 1, 0)
        common[0] = common[rows] = 0
        here = np.maximum(common[:-1], common[1:]) >= length
        if here.any():
            found = order[here]
            out[found[(first[found] <= c) & (c < first[found] + windows[found])], c] = True
    return out


def _repeating_in(table: pa.Table) -> pa.Table:
    """Runs of repeating windows of pieces in the order of their keys."""
    table = table.combine_chunks()
    data, offsets = tb.flat(table["piece"])
    sizes = np.diff(offsets)
    reach, windows, keys = (table[c].to_numpy().astype(np.int64) for c in ("reach", "windows", "key"))
    first = reach.max(initial=0) - reach
    columns = np.zeros((len(sizes), int((first + sizes).max(initial=0))), np.uint16)
    row = np.repeat(np.arange(len(sizes)), sizes)
    columns[row, np.arange(len(data)) - np.repeat(offsets[:-1], sizes) + first[row]] = data.astype(np.uint16) + 1
    groups = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    found = repeating(groups, columns, first, windows, LENGTH)
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    owner, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    start = table["start"].to_numpy().astype(np.int64)[owner] + begin - first[owner]
    return pa.table({"owner": table["owner"].take(pa.array(owner)), "start": pa.array(start), "windows": pa.array(end - begin)})


def _sorting(group: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole keys at a time, at least `group` rows; rows come in the order of their keys."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < group:
                continue
            table = pa.Table.from_batches(waiting)
            keys = table["key"].to_numpy()
            last, done = int(np.searchsorted(keys, keys[-1])), 0
            while done < last:
                stop = int(np.searchsorted(keys, keys[min(done + group, last) - 1], side="right"))
                yield from _repeating_in(table.slice(done, stop - done)).to_batches()
                done = stop
            waiting = table.slice(last).to_batches()
        if waiting:
            yield from _repeating_in(pa.Table.from_batches(waiting)).to_batches()

    return sort


def _removing(text: pa.Array, marks: pa.Array) -> pa.Array:
    """What is left of each text, and the runs that go, given windows as start and how many."""
    data, offsets = tb.flat(text)
    at = marks.offsets.to_numpy()
    flat = marks.flatten()
    starts = flat.field("start").to_numpy().astype(np.int64) + np.repeat(offsets[:-1], np.diff(at))
    ends = starts + flat.field("windows").to_numpy().astype(np.int64) + LENGTH - 1
    change = np.bincount(starts, minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1)
    covered = np.cumsum(change)[:-1] > 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = covered[:-1], covered[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    first, last = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
    of = np.searchsorted(offsets, first, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(first - offsets[of]), pa.array(last + 1 - offsets[of])], ["start", "end"])
    span_ends = np.searchsorted(of, np.arange(len(text) + 1)).astype(np.int32)
    kept_before = np.concatenate([[0], np.cumsum(~covered)])
    bounds = _offsets(kept_before[offsets])
    kept = pa.Array.from_buffers(pa.binary(), len(text), [None, bounds, pa.py_buffer(data[~covered])])
    return pa.StructArray.from_arrays([kept, pa.ListArray.from_arrays(pa.array(span_ends), spans)], ["kept", "spans"])


def _classes(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of pieces whose class has several members, and one piece of each class of a key with several classes.

    Equal pieces are counted before they are shuffled. Both tables that pieces and classes are joined with are written before, so that
    adaptive execution can split a class that much of the corpus shares, and a key that many classes do.
    """
    members = ["owner", "start", "windows", "reach", "cell", "width"]
    classes = pieces.groupBy("key", "content").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(*members)).alias("one"))
    classes = written(classes, "classes")
    same = pieces.join(classes.where("size > 1").select("key", "content"), ["key", "content"]).select("owner", "start", "windows")
    several = written(classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "keys")
    return same, classes.join(several, "key").select("key", "classes", "one.*")


def _with_bytes(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """Pieces with their bytes."""
    listed = pieces.groupBy("owner").agg(F.collect_list(F.struct("key", "classes", "start", "windows", "reach", "cell", "width")).alias("pieces"))
    cut = texts.join(listed, "owner").select("owner", "pieces", F.arrow_udf(_slices, "array<binary>")("text", "pieces").alias("bytes"))
    rows = cut.select("owner", F.inline(F.arrays_zip("pieces", "bytes")))
    return rows.select("owner", "pieces.*", F.col("bytes").alias("piece"))


def repeated_windows(df: DataFrame, id_col: str, text_col: str, group: int = GROUP) -> DataFrame:
    """Runs of windows that occur more than once: `owner` (identifier and hash of the text), `start` and `windows`."""
    text = whole(f"`{text_col}`")
    owner = F.struct(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("hash"))
    texts = df.select(owner.alias("owner"), text.alias("text"))
    listed = texts.where(F.octet_length("text") >= LENGTH)
    found = listed.select("owner", F.inline(F.arrow_udf(_pieces, f"array<{_PIECE}>")("text")))
    found = written(found, "pieces")
    same, differing = _classes(found)
    marks = [same]
    rows = written(_with_bytes(differing, texts), "piece-bytes")
    while True:
        small = rows.where(F.col("classes") <= group).repartition("key").sortWithinPartitions("key")
        marks.append(
            small.select("owner", "key", "start", "windows", "reach", "piece").mapInArrow(
                _sorting(group), "owner struct<id:string,hash:bigint>, start bigint, windows bigint"
            )
        )
        large = rows.where(F.col("classes") > group)
        if large.isEmpty():
            break
        halves = large.select("owner", F.col("start").alias("at"), "piece", F.inline(F.arrow_udf(_halves, f"array<{_PIECE}>")("piece", "reach", "windows", "cell", "width")))
        halves = halves.select(
            F.struct("owner", "at").alias("owner"), "key", "content", "start", "windows", "reach", "cell", "width",
            F.expr(f"substring(piece, start + 1, windows + {LENGTH} - 1)").alias("piece"),
        )
        halves = written(halves, "half-pieces")
        same, differing = _classes(halves.drop("piece"))
        marks.append(_absolute(same))
        joined = differing.join(halves.select("owner", "key", "start", "piece"), ["owner", "key", "start"])
        joined = joined.select(F.col("owner.owner").alias("owner"), "key", "classes", (F.col("owner.at") + F.col("start")).cast("int").alias("start"), "windows", "reach", "cell", "width", "piece")
        rows = written(joined, "piece-bytes")
    out = marks[0].select("owner", F.col("start").cast("bigint").alias("start"), F.col("windows").cast("bigint").alias("windows"))
    for more in marks[1:]:
        out = out.unionAll(more.select("owner", F.col("start").cast("bigint").alias("start"), F.col("windows").cast("bigint").alias("windows")))
    return out


def _absolute(marks: DataFrame) -> DataFrame:
    return marks.select(F.col("owner.owner").alias("owner"), (F.col("owner.at") + F.col("start")).alias("start"), "windows")


def without_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    results: tuple[str, str] = ("kept", "spans"),
    group: int = GROUP,
) -> DataFrame:
    """Each row's identifier with the bytes that are left of its text and the runs of bytes removed, as start and end.

    A byte goes if a string of LENGTH bytes covers it that also starts anywhere else, in the same text or another. A
    null text is empty; texts shorter than LENGTH stay whole. Repeated rows repeat each other. Rows may share
    identifiers or have none. Other columns are not read.
    """
    marks = repeated_windows(df, id_col, text_col, group).groupBy("owner")
    marks = marks.agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    text = whole(f"`{text_col}`")
    owner = F.struct(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("hash"))
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), owner.alias("owner"), text.alias("text")).join(marks, "owner", "left")
    none = F.array().cast("array<struct<start:bigint,windows:bigint>>")
    left = F.arrow_udf(_removing, "struct<kept:binary,spans:array<struct<start:bigint,end:bigint>>>")
    rows = rows.select("_id", "text", F.coalesce("marks", none).alias("marks")).withColumn("left", left("text", "marks"))
    return rows.select(F.col("_id").alias(id_col), F.col("left.kept").alias(results[0]), F.col("left.spans").alias(results[1]))
