"""Find, filter and replace text spans inside a row.

A span is ``struct<entity_type, start, end, score, text_preview>`` with half-open offsets counted in
code points. Everything here is a column expression, so a text table is scanned in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from veilspark.functions import span_batches as batches
from veilspark.functions.crypto import bind

SPAN_TYPE = "struct<entity_type:string,start:int,end:int,score:double,text_preview:string>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """Running fold of an array by an associative ``step`` (sum, greatest).

    The array is cut into blocks of about the square root of its length: fold the blocks, then fold
    within each. That costs n * sqrt(n) instead of n * n for texts with very many hits.
    """

    def fold(items: Column) -> Column:
        return F.aggregate(items, start, step)

    def by_blocks(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.size(items) - 1, width), lambda at: F.slice(items, at + 1, width)
        )
        return bind(
            blocks,
            lambda parts: bind(
                F.transform(parts, fold),
                lambda totals: F.flatten(
                    F.transform(
                        parts,
                        lambda part, j: bind(
                            fold(F.slice(totals, 1, j)),
                            lambda before: F.transform(
                                part, lambda _, i: step(before, fold(F.slice(part, 1, i + 1)))
                            ),
                        ),
                    )
                ),
            ),
        )

    return bind(
        values,
        lambda items: F.when(F.size(items) == 0, items).otherwise(by_blocks(items)),
    )


def _block(values: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))


def block_sums(values: Column) -> Column:
    """Sums of an integer array's blocks of about the square root of its length, for :func:`sum_before`."""

    def sums(width: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), width)
        return F.transform(starts, lambda at: _total(F.slice(values, at + 1, width)))

    return bind(_block(values), sums)


def sum_before(values: Column, sums: Column, at: Column) -> Column:
    """Sum of the first ``at`` values. Where few places of a text are asked for, this spares the running sum of all."""

    def whole(width: Column) -> Column:
        full = F.floor(at / width).cast("int")
        return _total(F.slice(sums, 1, full)) + _total(F.slice(values, full * width + 1, at - full * width))

    return bind(_block(values), whole)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def locate(matches: Column, gaps: Column) -> Column:
    """``array<struct<start, end, value>>`` from all matches and the pieces of text around them."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(
            F.slice(gaps, 1, F.size(found)), found, lambda gap, value: F.length(gap) + F.length(value)
        )
        return F.zip_with(
            found,
            running(steps, lambda a, b: a + b, F.lit(0)),
            lambda value, end: F.struct(
                (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")
            ),
        )

    return bind(matches, placed)


def find_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as ``array<struct<start, end, value>>``.

    Matches and the pieces between them come from two built-ins; offsets are running lengths. The
    pattern must not match the empty string.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = locate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def drop_repeats(spans: Column) -> Column:
    """Within one entity type, drop a span that lies inside another one with at least its score.

    One sweep in order of type and start, longest and best first, with a frontier that holds as many spans as overlap at one place,
    whatever the number of scores.
    """
    return F.arrow_udf(batches.settled(None), SPANS_TYPE)(spans)


def settled(spans: Column, threshold: float) -> Column:
    """As :func:`drop_repeats`, and of these the spans that reach the threshold, in report order: start, end, type."""
    return F.arrow_udf(batches.settled(float(threshold)), SPANS_TYPE)(spans)


def resolve_overlaps(spans: Column) -> Column:
    """Spans to replace: disjoint, in order, and covering every character any span covers.

    A span inside another is dropped whatever the scores are, since keeping the inner one alone would
    leave the rest of the outer one readable. Where two spans cross, the earlier one ends where the
    later one starts.
    """

    return F.arrow_udf(batches.resolved, SPANS_TYPE)(spans)


BLOCK = 256  # code points


def in_blocks(text: Column) -> Column:
    """A text as an array of blocks, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points ``[start, end)`` of a text in blocks. Only the blocks they lie in are read, whereas ``substring`` counts
    from the start of the text every time."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    here = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(here, start - first * BLOCK + 1, end - start)


def replace_spans(text: Column, spans: Column, replacement: Callable[[Column, Column], Column]) -> Column:
    """Rebuild the text around its spans, overlaps settled as by :func:`resolve_overlaps`; ``replacement`` gets (entity type, value)."""

    return rebuilt(F.arrow_udf(batches.pieces, batches.PIECES_TYPE)(F.make_valid_utf8(text), spans), replacement)


def rebuilt(cut_up: Column, replacement: Callable[[Column, Column], Column]) -> Column:
    """A text from its pieces; ``replacement`` gets (entity type, value)."""

    def joined(parts: Column) -> Column:
        shown = F.transform(parts["pieces"], lambda p: F.concat(p["before"], replacement(p["entity_type"], p["value"])))
        return F.concat(F.array_join(shown, ""), parts["tail"])

    return bind(cut_up, joined)


def outside(spans: Column, blocked: Column) -> Column:
    """Spans that overlap none of the blocked ones (``array<struct<start, end, ...>>``)."""
    return F.filter(
        spans,
        lambda s: ~F.exists(blocked, lambda b: (s["start"] < b["end"]) & (s["end"] > b["start"])),
    )
