"""Token counts by a byte-level BPE vocabulary, without encoding the text.

Before any text is read, every vocabulary string is merged by the rules; those that come out as one token form a
table. A pre-token found there counts as one without further work. Only the others are merged, once each while
remembered.

Added tokens of the vocabulary (such as an end-of-text mark) inside a text count as one each, and split the text.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.llm.pieces import Memo, splitter
from veilspark.llm.tables import whole, with_results

#: Counts of pieces remembered by a worker, once or twice as many.
REMEMBERED = 120_000

#: Fixed value: the pre-tokenizer pattern that files of this kind leave unsaid.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SHORT = 48


def _byte_letters() -> str:
    """The letter that stands for each byte in such a vocabulary: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


class TokenCounter:
    """Counts tokens of texts by a vocabulary file of the tokenizers library: byte-level BPE with its usual pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        known = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex")
        if not known or spec["normalizer"] or before.get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take their surroundings along")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        numbers = {letter: n for n, letter in enumerate(_byte_letters())}
        self._ranks: dict[int, int] = {}  # of a pair of token numbers
        self._made: list[int] = []  # the token number that a rule makes
        for one, other in pairs:
            self._ranks[numbers[one] << 20 | numbers[other]] = len(self._made)
            self._made.append(numbers.setdefault(one + other, len(numbers)))
        self._letters = _byte_letters()
        self._added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._added_pattern = regex.compile("|".join(map(regex.escape, self._added))) if self._added else None
        self._pieces = splitter(PATTERN)
        self._library = path
        self.memo = Memo(self._merged_count, self.whole_tokens(model["vocab"]), REMEMBERED)

    def whole_tokens(self, vocabulary: dict[str, int]) -> dict[str, int]:
        """The texts that are proven to encode alone as one token, with 1 for each."""
        byte = {letter: b for b, letter in enumerate(self._letters)}
        found = {}
        for token in vocabulary:
            if all(letter in byte for letter in token) and self._merge(bytes(byte[letter] for letter in token)) == 1:
                try:
                    found[bytes(byte[letter] for letter in token).decode()] = 1
                except UnicodeDecodeError:
                    pass  # part of a character: never a pre-token
        return found

    def _merge(self, data: bytes) -> int:
        """How many tokens are left when no rule applies any more."""
        if len(data) > _SHORT:
            return self._merge_long(data)
        parts, rank_of, made, none = list(data), self._ranks.get, self._made, len(self._made)
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(data, data[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at] = token = made[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 20 | token, none)
            if at < len(ranks):
                ranks[at] = rank_of(token << 20 | parts[at + 1], none)
        return len(parts)

    def _merge_long(self, data: bytes) -> int:
        """The same with a queue of pairs, in n log n."""
        parts, rank_of = list(data), self._ranks.get
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue = [(r, i) for i in range(len(parts) - 1) if (r := rank_of(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        count = len(parts)
        while queue:
            rank, i = heapq.heappop(queue)
            j = right[i]
            if parts[i] < 0 or j < 0 or rank_of(parts[i] << 20 | parts[j]) != rank:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self._made[rank], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            count -= 1
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := rank_of(parts[k] << 20 | parts[right[k]])) is not None:
                    heapq.heappush(queue, (r, k))
        return count

    def _merged_count(self, piece: str) -> float:
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            return float("nan")  # the library may class this character otherwise: it splits the text itself
        return self._count_letters(piece)

    def _count_letters(self, piece: str) -> int:
        return self._merge(piece.encode())

    def _split_by_library(self, text: str) -> Iterator[str]:
        from tokenizers import Tokenizer

        for _, (start, end) in Tokenizer.from_file(self._library).pre_tokenizer.pre_tokenize_str(text):
            yield text[start:end]

    def _count_plain(self, text: str) -> int:
        total = sum(map(self.memo.__getitem__, self._pieces(text)))
        if total != total:
            total = sum(map(self._count_letters, self._split_by_library(text)))
        return total

    def count(self, text: str) -> int:
        if not self._added or not any(t in text for t in self._added):
            return self._count_plain(text)
        parts = self._added_pattern.split(text)
        return len(parts) - 1 + sum(map(self._count_plain, parts))


@lru_cache(maxsize=4)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _counting(path: str) -> Callable[[pa.Array], pa.Array]:
    def counts(text: pa.Array) -> pa.Array:
        count = _counter(path).count
        return pa.array([count(t.as_py()) for t in text], pa.int64())

    return counts


def token_count(text: str | Column, path: str) -> Column:
    """How many tokens a text has, by the vocabulary file at `path`, which every executor must be able to read.

    A null or empty text has none. No tokens are added at its ends, and nothing is cut off.
    """
    return F.arrow_udf(_counting(path), "bigint")(whole(text))


def token_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """The input with `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens).

    An input column with the name of a result is replaced. Each row is counted by itself, so repeated rows, ties and
    empty tables need no rule.
    """
    text = whole(f"`{text_col}`")
    count = token_count(text, path)
    counted = F.struct(F.octet_length(text).cast("bigint").alias("n_bytes"), count.alias("n_tokens"))
    counted = with_results(df, counted, ["n_bytes", "n_tokens"])
    return with_results(counted, F.struct((F.col("n_tokens") > limit).alias("over_limit")), ["over_limit"])
