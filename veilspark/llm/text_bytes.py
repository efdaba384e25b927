"""Arrow text columns as flat UTF-8 bytes, their words, and hashes of any byte range.

Everything here works on a block of whole texts at a time, so that memory follows the block and not the batch.
A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time. A longer text is a block of its own.
BLOCK_BYTES = 1_000_000

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Bytes of words: all but white space, or ASCII letters and digits with everything beyond ASCII.
NOT_SPACE, ALPHANUMERIC = ~_SPACES, _ALNUM

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Multipliers of a published 64-bit finaliser, and odd bases of the range hashes.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each text starts (and the last one ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have at most `limit` bytes together, or one longer text."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over the whole range; equal values stay equal, others differ."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


class RangeHash:
    """Hashes of byte ranges of one block, each from two lookups.

    A polynomial modulo 2^64 with an odd base: prefix sums give any range's sum, and the inverse of the base moves
    it to a common origin.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        powers, self._inverse = self._tables(base, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._sums[1:])

    @classmethod
    def _tables(cls, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < size:
            size = max(size, BLOCK_BYTES + 1)
            tables = []
            for factor in (base, pow(base, -1, 1 << 64)):
                table = np.full(size, factor, np.uint64)
                table[0] = 1
                tables.append(np.cumprod(table))
            have = (tables[0], tables[1])
            if size <= 2 * BLOCK_BYTES:
                cls._powers[base] = have
        return have

    def every(self, size: int) -> np.ndarray:
        """The hash of each range of so many bytes, by its start."""
        count = max(0, len(self._sums) - size)
        return mixed((self._sums[size : size + count] - self._sums[:count]) * self._inverse[:count] + np.uint64(size))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a block: `starts` and `ends` in bytes, `first[i]` the first word of text i, `hashes` after lower-casing A-Z."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        text_starts = offsets[:-1][offsets[:-1] < len(data)]
        before[text_starts] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[text_starts[text_starts > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.lowered = LOWER[data]
        self.hashes = RangeHash(self.lowered)(self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


#: Odd multiplier that chains word hashes.
_CHAIN = np.uint64(0x9FB21C651E98DF25)


def chained(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of so many consecutive values; runs may cross texts."""
    size = max(0, len(hashes) - words + 1)
    out = np.full(size, words, np.uint64)
    for j in range(words):
        out = mixed(out * _CHAIN + hashes[j : j + size])
    return out


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of `size` words inside a text; a text of fewer words, but not none, is one window."""
    hashes, counts = words.hashes, words.counts
    full = counts >= size
    place = np.arange(len(hashes))
    last = np.repeat(words.first[1:], counts)
    keep = place + size <= last
    starts = place[keep]
    out = chained(hashes, size)[starts]
    short = np.flatnonzero(~full & (counts > 0))
    if len(short):
        extra = np.concatenate([chained(hashes[words.first[i] : words.first[i + 1]], int(counts[i])) for i in short])
        starts = np.concatenate([starts, words.first[short]])
        out = np.concatenate([out, extra])
        order = np.argsort(starts, kind="stable")
        starts, out = starts[order], out[order]
    return out, starts


def chained_columns(values: np.ndarray, seed: int) -> np.ndarray:
    """One hash of each row of a matrix."""
    out = np.full(len(values), seed, np.uint64)
    for column in values.T:
        out = mixed(out * _CHAIN + column)
    return out
