"""Byte-level BPE encoding and decoding in linear time.

A piece's bytes become Latin-1 characters, so that an Aho-Corasick automaton of the vocabulary finds the tokens that match
at each byte. The encoder takes the longest match that is compatible with the token before, shortens it where it is not, and
steps back where nothing fits; a byte position that failed once is not entered again. Two adjacent tokens are
compatible if merging their joined bytes gives the two again, which is remembered. A sequence whose neighbours are all
compatible is the one that merging in rank order gives.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.llm import text_bytes as tb
from veilspark.llm.pieces import Memo, splitter
from veilspark.llm.tables import fresh, whole

#: Pieces and token pairs remembered by a worker, once or twice as many. A pair takes little room.
REMEMBERED, PAIRS = 60_000, 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, from a file of base64 tokens."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class Encoder:
    """Ids of texts by a vocabulary of ranks; each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a token for some byte")
        self._ranks = ranks
        self._pieces = splitter(pattern)
        self._tokens = {rank: token for token, rank in ranks.items()}
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self._merge(token) == [token]:
                self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._shorter: dict[int, int | None] = {}
        self._compatible = Memo(self._merge_apart, {}, PAIRS)
        self.memo = Memo(self._encode_piece, {}, REMEMBERED)

    def _merge(self, data: bytes) -> list[bytes]:
        """Merging in rank order, for the few bytes of one or two tokens."""
        parts, rank_of, none = [data[i : i + 1] for i in range(len(data))], self._ranks.get, len(self._ranks)
        ranks = [rank_of(data[i : i + 2], none) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at] = joined = parts[at] + parts[at + 1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + joined, none)
            if at < len(ranks):
                ranks[at] = rank_of(joined + parts[at + 1], none)
        return parts

    def _merge_apart(self, pair: int) -> bool:
        """Whether merging the joined bytes of two tokens, of which each merges to itself, never joins across their border."""
        one = self._tokens[pair >> 32]
        data, left = one + self._tokens[pair & 0xFFFFFFFF], len(one)
        parts, rank_of, none = [data[i : i + 1] for i in range(len(data))], self._ranks.get, len(self._ranks)
        ranks = [rank_of(data[i : i + 2], none) for i in range(len(data) - 1)]
        while (best := min(ranks)) < none:
            at = ranks.index(best)
            if at == left - 1:
                return False
            left -= at < left
            parts[at] = joined = parts[at] + parts[at + 1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + joined, none)
            if at < len(ranks):
                ranks[at] = rank_of(joined + parts[at + 1], none)
        return True

    def _shorten(self, rank: int) -> int | None:
        """The longest token that is a proper beginning of a token."""
        if rank not in self._shorter:
            token = self._tokens[rank].decode("latin-1")
            ends = (n for n in range(len(token) - 1, 0, -1) if token[:n] in self._automaton)
            self._shorter[rank] = next((self._automaton.get(token[:n])[0] for n in ends), None)
        return self._shorter[rank]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if (whole_piece := self._ranks.get(data)) is not None:
            return (whole_piece,)
        return self.encode_bytes(data)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        text, compatible = data.decode("latin-1"), self._compatible
        out: list[int] = []
        for end, (rank, size) in self._automaton.iter_long(text):
            if out and not compatible[out[-1] << 32 | rank]:
                return self._backtrack(text, out, end - size + 1, rank)
            out.append(rank)
        return tuple(out)

    def _longest(self, text: str, at: int) -> int:
        """The longest token that begins at a byte; every byte is a token, so the first match begins there."""
        return next(self._automaton.iter_long(text, at))[1][0]

    def _backtrack(self, text: str, out: list[int], at: int, rank: int | None) -> tuple[int, ...]:
        """Goes on after the tokens `out`, which end at byte `at`, where `rank` is the longest match."""
        tokens, compatible, failed = self._tokens, self._compatible, set()
        while at < len(text):
            while rank is not None:
                end = at + len(tokens[rank])
                if end not in failed and (not out or compatible[out[-1] << 32 | rank]):
                    break
                rank = self._shorten(rank)
            if rank is None:
                failed.add(at)
                rank = out.pop()
                at -= len(tokens[rank])
            else:
                out.append(rank)
                at = end
                rank = self._longest(text, at) if at < len(text) else None
        return tuple(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        found = [list(chain.from_iterable(map(self.memo.__getitem__, self._pieces(t)))) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> pa.Array:
    """Each id's bytes; null for an id that is not used."""
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_binary())


def _encoding(path: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    def encode(text: pa.Array) -> pa.Array:
        encoder = _encoder(path, pattern)
        _, offsets = tb.flat(text)
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i, j in tb.blocks(offsets):
            some, many = encoder.encode(text.slice(i, j - i).to_pylist())
            ids.append(some)
            counts.append(many)
        ends = np.cumsum(np.concatenate(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return encode


def _decoding(path: str) -> Callable[[pa.Array], pa.Array]:
    def decode(ids: pa.Array) -> pa.Array:
        offsets = ids.offsets.to_numpy()
        tokens = _token_bytes(path).take(ids.flatten())
        if tokens.null_count:
            raise ValueError("an id that the vocabulary does not have")
        data, token_ends = tb.flat(tokens)
        ends = token_ends[offsets - offsets[0]].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    return decode


def _both(path: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    encode, decode = _encoding(path, pattern), _decoding(path)

    def both(text: pa.Array) -> pa.Array:
        ids = encode(text)
        return pa.StructArray.from_arrays([ids, decode(ids)], ["ids", "data"])

    return both


def encoded(text: str | Column, path: str, pattern: str) -> Column:
    """A text's ids as array<int>, without special tokens; null and empty texts have none.

    `path` names a file of ranks that every executor can read.
    """
    return F.arrow_udf(_encoding(path, pattern), "array<int>")(whole(text))


def decoded(ids: str | Column, path: str) -> Column:
    """The bytes of an array<int> of ids; a null array gives no bytes, an unknown id fails."""
    column = F.col(ids) if isinstance(ids, str) else ids
    return F.arrow_udf(_decoding(path), "binary")(F.coalesce(column, F.array().cast("array<int>")))


def encode_and_decode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids", data: str = "decoded"
) -> DataFrame:
    """The input with the ids of each text and the bytes they decode to; input columns of these names are replaced.

    Each row is encoded by itself, so repeated rows, ties and empty tables need no rule.
    """
    # in one worker: two functions in a row would hold two
    inner = fresh("coded", df)
    both = F.arrow_udf(_both(path, pattern), "struct<ids:array<int>,data:binary>")
    out = df.withColumn(inner, both(whole(f"`{text_col}`")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (ids, data)]
    return out.select(*kept, F.col(inner)["ids"].alias(ids), F.col(inner)["data"].alias(data))
