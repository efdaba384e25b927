"""What is done to the spans of a text after its patterns were matched, on Arrow batches inside the tasks.

Spark interprets each step of a lambda over an array for each span, which cost several times the matching. The matches still come
from Spark's own expressions; places, contexts and overlaps are worked out here, text by text. Offsets count code points.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: (entity_type, start, end, score, text_preview)
Span = tuple[str, int, int, float, str | None]
#: What a match is reported as: type, score without and with a context word near it, context words.
Rule = tuple[str, float, float, frozenset[str]]

_SPAN = pa.struct(
    [("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text_preview", pa.string())]
)
#: White space as of ``(?U)\\s``.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ASCII_GAP = re.compile("[^0-9A-Z_a-z]+")
_WORD_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc")
#: Alphabetic symbols and the join controls, which belong to words too.
_WORD_SYMBOLS = ("\u24b6-\u24e9", "\U0001f130-\U0001f149", "\U0001f150-\U0001f169", "\U0001f170-\U0001f189", "\u200c\u200d")


@cache
def _gap() -> re.Pattern[str]:
    """What stands between words: ``(?U)\\W+`` of any text."""
    held = [unicodedata.category(chr(c)) in _WORD_CATEGORIES for c in range(sys.maxunicode + 1)]
    edges = np.flatnonzero(np.diff(np.array([False, *held, False], dtype=np.int8))).reshape(-1, 2)
    ranges = "".join(f"\\U{first:08x}-\\U{end - 1:08x}" for first, end in edges.tolist())
    return re.compile(f"[^{ranges}{''.join(_WORD_SYMBOLS)}]+")


def _context(text: str, start: int, tokens: int) -> str:
    """The last tokens between white space before a place. Only as much of the text is read as they take."""
    width = 64
    while True:
        at = max(start - width, 0)
        parts = _SPACES.sub(" ", text[at:start]).rstrip(" ").rsplit(" ", tokens)
        if len(parts) > tokens:
            return " ".join(parts[1:])
        if not at:
            return " ".join(parts)
        width *= 4


def _is_near(text: str, start: int, words: frozenset[str], tokens: int) -> bool:
    before = _context(text, start, tokens).lower()
    return not words.isdisjoint((_ASCII_GAP if before.isascii() else _gap()).split(before))


def _lists(column: pa.Array) -> tuple[list[int], pa.Array]:
    """Ends of each row's items and all items; a null row has none."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return [0, *ends.tolist()], column.flatten()


def _values(column: pa.Array) -> list:
    if pa.types.is_string(column.type) or not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _rows(spans: pa.Array) -> list[list[Span] | None]:
    ends, items = _lists(spans)
    every = list(zip(*map(_values, items.flatten()), strict=True))
    if not spans.null_count:
        return [every[a:z] for a, z in zip(ends, ends[1:])]
    return [None if n else every[a:z] for n, a, z in zip(spans.is_null().to_pylist(), ends, ends[1:])]


def _column(rows: Sequence[Sequence[tuple] | None], kind: pa.DataType) -> pa.Array:
    every = [item for row in rows if row for item in row]
    fields = list(zip(*every)) if every else [()] * kind.num_fields
    items = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, kind)], fields=list(kind))
    ends = np.cumsum([0, *[len(row) if row else 0 for row in rows]]).astype(np.int32)
    null = pa.array([row is None for row in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), items, mask=null)


def located(
    rules: Sequence[Rule], tokens: int, threshold: float | None = None, with_pieces: bool = False
) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Spans of the matches of each rule, in order of the rules; with a threshold settled as by :func:`settled`.

    A text comes with ``array<struct<rule, value, gap, valid>>``: its matches by rule and place, the length of the piece between a
    match and the one before it (null for a match that occurs once), and whether a match is valid. A null text has no spans, settled ones null.
    ``with_pieces`` adds what :func:`pieces` gives for the spans, in the same call.
    """
    plain_words = [[w for w in words if w.isascii()] for *_, words in rules]
    always = [plain == boosted for _, plain, boosted, _ in rules]

    def spans(text: str, hits: list[tuple]) -> list[Span]:
        out, end, last, lowered = [], 0, None, None
        for number, value, gap, valid in hits:
            if number != last:
                end, last = 0, number
            start = text.find(value) if gap is None else end + gap
            end = start + len(value)
            if not valid:
                continue
            kind, score, boosted, words = rules[number]
            if not always[number]:
                if lowered is None:
                    lowered = text.lower()
                # the words near a match are looked at only if the text holds a context word at all
                held = len(plain_words[number]) < len(words)
                for w in plain_words[number]:
                    if held or w in lowered:
                        held = True
                        break
                if held and _is_near(text, start, words, tokens):
                    score = boosted
            out.append((kind, start, end, score, value))
        return out if threshold is None else reported(out, threshold)

    def run(text: pa.Array, hits: pa.Array) -> pa.Array:
        texts = _values(text)
        rows = [spans(t, row) if row else [] for t, row in zip(texts, _rows(hits), strict=True)]
        if threshold is not None and text.null_count:
            rows = [None if t is None else row for t, row in zip(texts, rows)]
        found = _column(rows, _SPAN)
        return pa.StructArray.from_arrays([*_cut(texts, rows), found], ["pieces", "tail", "spans"]) if with_pieces else found

    return run


def _descending(score: float | None) -> float:
    return float("-inf") if score is None else -score


def undominated(spans: Sequence[Span]) -> list[Span]:
    """Spans without those that lie inside another one of their type with at least their score, by type and start.

    Only the frontier is looked at: earlier spans that reach beyond the current start, and that no other of them outreaches and outscores.
    """
    if len(spans) < 2:
        return list(spans)
    ordered = sorted(spans, key=lambda s: (s[0], s[1], -s[2], _descending(s[3])))
    if len({s[0] for s in spans}) == len(spans):
        return ordered
    kept: list[Span] = []
    frontier: list[Span] = []
    for s in ordered:
        kind, start, end, score = s[:4]
        frontier = [o for o in frontier if o[0] == kind and o[2] > start]
        if any(o[2] >= end and o[3] >= score for o in frontier if None not in (o[3], score)):
            continue
        frontier = [o for o in frontier if o[2] > end or (None not in (o[3], score) and o[3] > score)]
        frontier.append(s)
        kept.append(s)
    return kept


def reported(spans: Sequence[Span], threshold: float) -> list[Span]:
    """Spans that no other of their type covers and that reach the threshold, by start, end and type."""
    kept = [s for s in undominated(spans) if s[3] is not None and s[3] >= threshold]
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def settled(threshold: float | None) -> Callable[[pa.Array], pa.Array]:
    """Spans without those that another one of their type covers; with a threshold as :func:`reported`."""

    def settle(spans: Sequence[Span]) -> list[Span]:
        return undominated(spans) if threshold is None else reported(spans, threshold)

    return lambda spans: _column([None if row is None else settle(row) for row in _rows(spans)], _SPAN)


def disjoint(spans: Sequence[Span]) -> list[Span]:
    """Outermost spans, each ending where the next one starts. Of equal ones the best score, then the first type name, stays."""
    if len(spans) < 2:
        return list(spans)
    kept: list[Span] = []
    reach = -1
    for s in sorted(spans, key=lambda s: (s[1], -s[2], _descending(s[3]), s[0])):
        if s[2] > reach:
            kept.append(s)
            reach = s[2]
    following = [s[1] for s in kept[1:]] + [reach]
    return [(s[0], s[1], min(s[2], after), *s[3:]) for s, after in zip(kept, following)]


def resolved(spans: pa.Array) -> pa.Array:
    return _column([None if row is None else disjoint(row) for row in _rows(spans)], _SPAN)


PIECES_TYPE = "struct<pieces:array<struct<before:string,entity_type:string,value:string>>,tail:string>"
_PIECE = pa.struct([("before", pa.string()), ("entity_type", pa.string()), ("value", pa.string())])


def _cut(texts: Sequence[str | None], rows: Sequence[Sequence[Span] | None]) -> tuple[pa.Array, pa.Array]:
    def cut(text: str | None, row: Sequence[Span] | None) -> tuple[list[tuple[str, str, str]] | None, str | None]:
        if text is None or row is None:
            return None, None
        at, out = 0, []
        for kind, start, end, _, _ in disjoint(row):
            out.append((text[at:start], kind, text[start:end]))
            at = end
        return out, text[at:]

    cuts = [cut(t, row) for t, row in zip(texts, rows, strict=True)]
    return _column([c for c, _ in cuts], _PIECE), pa.array([tail for _, tail in cuts], pa.string())


def pieces(text: pa.Array, spans: pa.Array) -> pa.Array:
    """A text cut at its spans, overlaps settled as by :func:`disjoint`; null for a null text or null spans."""
    return pa.StructArray.from_arrays(_cut(_values(text), _rows(spans)), ["pieces", "tail"])
