"""Benchmark decontamination with suffix arrays of the training texts.

The words of a block of texts form one shard; its suffix array holds the places whose first two words begin a suffix of
the benchmark, sorted by the words that follow. Every suffix of the benchmark narrows its range of that array word by word,
by binary search, up to the length of a window. Windows that match at places side by side, in the text and in the item, are
one longer match, so the longest matches and all places of them follow without a deeper sort. The words under matching
windows are hit.

Texts never leave their task. The benchmark is the stated query set: the driver reads it and broadcasts it in blocks of
bounded size, one in its memory at a time, and what the blocks before have found travels with the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.llm import text_bytes as tb
from veilspark.llm.tables import fresh, whole, with_results

RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

#: Words of a window, and bytes of benchmark text searched at a time.
WINDOW, BLOCK_BYTES = 10, 8_000_000

_MATCH = ["item", "item_start", "start", "length"]
_FOUND = (
    "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,longest:bigint,"
    "matches:array<struct<item:string,item_start:bigint,start:bigint,length:bigint>>>"
)


@dataclass(frozen=True)
class Queries:
    """Words of a block of benchmark items: all suffixes, and which of them are windows of which items."""

    hashes: np.ndarray
    starts: np.ndarray  # for each word, the first word of its item
    ends: np.ndarray  # for each word, the end of its item
    lengths: np.ndarray  # words of the window that begins at each word, 0 if none does
    items: np.ndarray  # the item of each word
    ids: tuple[str | None, ...]

    @classmethod
    def of(cls, texts: list[str], ids: list[str | None], window: int) -> Queries:
        data, offsets = tb.flat(pa.array(texts, pa.string()))
        words = tb.Words(data, offsets, tb.ALPHANUMERIC)
        item_starts, ends = np.repeat(words.first[:-1], words.counts), np.repeat(words.first[1:], words.counts)
        lengths = np.zeros(len(words.hashes), np.int64)
        _, starts = tb.windows(words, window)
        lengths[starts] = np.minimum(window, (ends - np.arange(len(ends)))[starts])
        return cls(words.hashes, item_starts, ends, lengths, words.texts(), tuple(ids))


def _heads(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the two words that begin at each word, 0 where the text ends before."""
    out = np.zeros(len(hashes), np.uint64)
    place = np.arange(len(hashes))
    pairs = place + 2 <= ends
    if len(hashes) > 1:
        out[:-1] = tb.chained(hashes, 2)
    out[~pairs] = 0
    return out


def _suffixes(words: np.ndarray, ends: np.ndarray, queries: Queries, depth: int) -> np.ndarray:
    """The suffix array: places whose first words begin a query, in the order of their first `depth` words."""
    own, theirs = _heads(words, ends), _heads(queries.hashes, queries.ends)
    begins = np.isin(own, theirs) & (own != 0)
    if (alone := queries.lengths == 1).any():
        begins |= np.isin(words, queries.hashes[alone])
    places = np.flatnonzero(begins)
    columns = []
    for d in range(depth):
        at = places + d
        inside = at < ends[places]
        columns.append(np.where(inside, words[np.where(inside, at, 0)], 0))
    return places[np.lexsort(columns[::-1])] if len(places) else places


def _narrow(array: np.ndarray, words: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, d: int):
    """Ranges of the suffix array, from those that agree on d words to those that agree on the next as well."""

    def bound(after: bool) -> np.ndarray:
        lo, hi = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            at = array[mid] + d
            inside = at < ends[array[mid]]
            value = np.where(inside, words[np.where(inside, at, 0)], 0)
            right = value <= wanted[open_] if after else value < wanted[open_]
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)

    return bound(False), bound(True)


def matches(words: np.ndarray, ends: np.ndarray, queries: Queries, depth: int) -> tuple[np.ndarray, ...]:
    """Matches of a window or more that cannot be extended, as place, words and query suffix, and the longest match at each place."""
    array = _suffixes(words, ends, queries, depth)
    longest = np.zeros(len(words), np.int64)
    active = np.arange(len(queries.hashes))
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(array), np.int64)
    places, sizes, sources = [], [], []
    for d in range(depth):
        live = np.flatnonzero((low < high) & (active + d < queries.ends[active]))
        active, low, high = active[live], low[live], high[live]
        if not len(active):
            break
        low, high = _narrow(array, words, ends, low, high, queries.hashes[active + d], d)
        found = low < high
        active, low, high = active[found], low[found], high[found]
        change = np.bincount(low, minlength=len(array) + 1) - np.bincount(high, minlength=len(array) + 1)
        longest[array[np.cumsum(change)[:-1] > 0]] = d + 1
        done = np.flatnonzero(queries.lengths[active] == d + 1)
        if len(done):
            counts = high[done] - low[done]
            step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            places.append(array[np.repeat(low[done], counts) + step])
            sizes.append(np.full(counts.sum(), d + 1))
            sources.append(np.repeat(active[done], counts))
    empty = np.zeros(0, np.int64)
    places, sizes, sources = (np.concatenate(x) if x else empty for x in (places, sizes, sources))
    order = np.lexsort((places, places - sources))
    places, sizes, sources = places[order], sizes[order], sources[order]
    # A window one word on in the same text and the same item continues a match; an item shorter than a window has no other.
    joins = (np.diff(places) == 1) & (np.diff(sources) == 1) & (np.diff(ends[places]) == 0) & (np.diff(queries.ends[sources]) == 0)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(places)), bool), ~joins]))
    steps = np.diff(np.append(first, len(places)))
    lengths = sizes[first] + steps - 1
    np.maximum.at(longest, places, np.repeat(lengths + places[first], steps) - places)
    return places[first], lengths, sources[first], longest


def _spans(places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal runs."""
    order = np.argsort(places, kind="stable")
    starts, ends = places[order], np.maximum.accumulate((places + sizes)[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(first)
    return starts[at], ends[np.append(at[1:] - 1, len(ends) - 1)] if len(at) else ends


def _in_block(data: np.ndarray, offsets: np.ndarray, queries: Queries, window: int) -> tuple[np.ndarray, ...]:
    """For a block of texts: words and longest match of each, then text, start and end of each run of hit words, then text, item,
    place in the item, place in the text and length of each match."""
    found = tb.Words(data, offsets, tb.ALPHANUMERIC)
    ends = np.repeat(found.first[1:], found.counts)
    places, sizes, sources, longest = matches(found.hashes, ends, queries, window)
    texts = found.texts()
    most = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(most, texts, longest)
    of = texts[places]
    starts, stops = _spans(places + of, sizes)  # a gap of one between texts, so that runs end with them
    at = np.searchsorted(found.first[:-1] + np.arange(len(most)), starts, side="right") - 1
    base = found.first[at] + at
    order = np.lexsort((queries.items[sources], places))  # places of one text are together
    of, places, sources, sizes = of[order], places[order], sources[order], sizes[order]
    found_in = (of, queries.items[sources], sources - queries.starts[sources], places - found.first[of], sizes)
    return found.counts, most, at, starts - base, stops - base, *found_in


def _lists(owners: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    """A list for each row, of the values whose owner it is; owners ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(rows + 1)).astype(np.int32)), values)


def _with_former(former: pa.Array, rows: int, at: np.ndarray, starts: np.ndarray, stops: np.ndarray, longest: np.ndarray):
    """Runs and longest matches together with those of the blocks before."""
    spans = former.field("spans")
    owners = np.repeat(np.arange(rows), np.diff(spans.offsets.to_numpy()))
    own = spans.flatten()
    at = np.concatenate([owners, at])
    starts = np.concatenate([own.field("start").to_numpy(), starts])
    stops = np.concatenate([own.field("end").to_numpy(), stops])
    reach = int(stops.max(initial=0)) + 1
    first, last = _spans(at * reach + starts, stops - starts)
    return first // reach, first % reach, last - first // reach * reach, np.maximum(longest, former.field("longest").to_numpy())


def _finder(shared: Broadcast, window: int) -> tuple[Callable[..., pa.Array], Callable[..., pa.Array]]:
    def found(text: pa.Array, former: pa.Array | None) -> pa.Array:
        queries: Queries = shared.value
        data, offsets = tb.flat(text)
        rows = len(text)
        parts = [tuple(np.zeros(0, np.int64) for _ in range(10))]
        for i, j in tb.blocks(offsets):
            part = _in_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], queries, window)
            parts.append((*part[:2], part[2] + i, *part[3:5], part[5] + i, *part[6:]))
        counts, longest, at, starts, stops, of, items, *places = (np.concatenate(x) for x in zip(*parts))
        columns = [pa.array(queries.ids, pa.string()).take(pa.array(items)), *map(pa.array, places)]
        matches = pa.StructArray.from_arrays(columns, _MATCH)
        if former is not None:
            at, starts, stops, longest = _with_former(former, rows, at, starts, stops, longest)
            before = former.field("matches")
            of = np.concatenate([np.repeat(np.arange(rows), np.diff(before.offsets.to_numpy())), of])
            own = before.flatten()
            columns = [pa.concat_arrays([own.field(name), matches.field(name)]) for name in _MATCH]
            order = np.argsort(of, kind="stable")
            of, matches = of[order], pa.StructArray.from_arrays(columns, _MATCH).take(pa.array(order))
        spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(stops)], ["start", "end"])
        columns = [pa.array(counts), _lists(at, spans, rows), pa.array(longest), _lists(of, matches, rows)]
        return pa.StructArray.from_arrays(columns, ["n_words", "spans", "longest", "matches"])

    def first(text: pa.Array) -> pa.Array:
        return found(text, None)

    def later(text: pa.Array, former: pa.Array) -> pa.Array:
        return found(text, former)

    return first, later


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items, in blocks of bounded size; one empty block if there is none."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), whole(f"`{text_col}`").alias("text"))
    ids, texts, size, some = [], [], 0, False
    for item, text in items.toLocalIterator():
        if texts and size + len(text.encode()) > block_bytes:
            yield ids, texts
            ids, texts, size, some = [], [], 0, True
        ids.append(item)
        texts.append(text)
        size += len(text.encode())
    if texts or not some:
        yield ids, texts


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    into: str = "found",
) -> DataFrame:
    """The input with a struct column: `n_words`, `spans` (maximal runs of hit words, as start and end), `longest`, `matches` and `items`.

    `matches` are all verbatim matches of a window or more that cannot be extended: the item, the word of it where the match
    begins, the word of the text where it begins and its length in words. `items` are the identifiers of their items, as
    strings in their order; an item without an identifier is in `matches` and hits words but is not in `items`, and one without words is
    never found. `longest` is the longest verbatim match in words, of two words or more, or a window if that is shorter. Texts that
    are null or have no words are clean. An input column called `into` is replaced.
    """
    text = whole(f"`{text_col}`")
    found = None
    context = df.sparkSession.sparkContext
    for ids, texts in _blocks(benchmark, item_col, benchmark_text, block_bytes):
        first, later = _finder(context.broadcast(Queries.of(texts, ids, window)), window)
        if found is None:
            df, found = df.withColumn(into, F.arrow_udf(first, _FOUND)(text)), F.col(f"`{into}`")
        else:
            df = df.withColumn(into, F.arrow_udf(later, _FOUND)(text, found))
    items = F.array_sort(F.array_distinct(F.filter(found["matches"]["item"], lambda i: i.isNotNull())))
    return df.withColumn(into, found.withField("items", items))


def contamination(df: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The input with `n_words`, `n_hit` (words inside any occurring window), `n_items`, `items_sha256` and `contaminated`.

    An input column with the name of a result is replaced; everything else as `find_contamination`.
    """
    into = fresh("found", df)
    found = find_contamination(df, benchmark, into=into, **parameters)
    hit = F.aggregate(F.col(into)["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    digest = F.struct(
        F.col(into)["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(F.col(into)["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.col(into)["items"], ","), 256).alias("items_sha256"),
        (F.size(F.col(into)["spans"]) > 0).alias("contaminated"),
    )
    return with_results(found, digest, RESULTS).drop(into)


def decontaminated(df: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows without an occurring window."""
    into = fresh("found", df)
    found = find_contamination(df, benchmark, into=into, **parameters)
    return found.where(F.size(F.col(into)["spans"]) == 0).drop(into)
