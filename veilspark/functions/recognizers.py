"""Registry of pattern recognizers and the expressions that apply it to a text column.

Patterns follow Unicode word and digit classes, use no lookaround and never match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from veilspark.functions import span_batches as batches, spans as sp
from veilspark.functions.crypto import bind

CONTEXT_WORDS_BEFORE = 5
CONTEXT_BOOST = 0.35
CONTEXT_MINIMUM = 0.4


@dataclass(frozen=True)
class Recognizer:
    """One entity type found by a pattern.

    ``validator`` checks the matched text; where it holds the score is 1, where it fails the match
    is dropped. ``hint`` is a literal every match contains: texts without it skip the pattern.
    """

    entity_type: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    validator: Callable[[Column], Column] | None = field(default=None, compare=False)
    ignore_case: bool = True
    hint: str = ""

    def __post_init__(self) -> None:
        if not 0 <= self.score <= 1:
            raise ValueError("a score must be between 0 and 1")

    @property
    def regex(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern

    @property
    def scores(self) -> tuple[float, float]:
        """Score of a match without and with a context word near it. A validated match has the best score."""
        plain = 1.0 if self.validator else float(self.score)
        boosted = min(1.0, max(plain + CONTEXT_BOOST, CONTEXT_MINIMUM))
        return _rounded(plain), _rounded(boosted)


def _rounded(score: float) -> float:
    """As Spark's ``round`` to four places."""
    return float(Decimal(repr(score)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))


def iban_valid(value: Column) -> Column:
    """Mod-97 check: move four characters to the end, read letters as 10..35, expect remainder 1."""
    compact = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    codes = F.transform(F.split(turned, ""), F.ascii)
    remainder = F.aggregate(
        codes,
        F.lit(0),
        lambda acc, c: F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97),
    )
    return remainder == 1


def ssn_valid(value: Column) -> Column:
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    return (
        ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")
    )


# Patterns, scores and context words of the two house identifiers.
CUSTOMER_ID = Recognizer(
    "CUSTOMER_ID", r"\bCUST(?:-[A-Z]{2})?-\d{6,8}\b", 0.85, ("customer", "client", "id"), hint="-"
)
CASE_ID = Recognizer(
    "CASE_ID", r"\bCASE-\d{4}-\d{4}\b", 0.85, ("case", "ticket", "investigation"), hint="-"
)

_PHONE_CONTEXT = ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MONTH, _DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"

EMAIL = Recognizer(
    "EMAIL_ADDRESS",
    r"\b[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}\b",
    1.0,
    ("email",),
    hint="@",
)
INTERNATIONAL_PHONE = Recognizer(
    "PHONE_NUMBER",
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}\b",
    0.4,
    _PHONE_CONTEXT,
    hint="+",
)
NATIONAL_PHONE = Recognizer("PHONE_NUMBER", r"\(\d{3}\) ?\d{3}-\d{4}\b", 0.4, _PHONE_CONTEXT, hint="(")
DASHED_PHONE = Recognizer("PHONE_NUMBER", r"\b\d{3}-\d{3}-\d{4}\b", 0.4, _PHONE_CONTEXT, hint="-")
CREDIT_CARD = Recognizer(
    "CREDIT_CARD",
    r"\b\d(?:[ -]?\d){12,18}\b",
    0.3,
    ("credit", "card", "visa", "mastercard", "cc", "amex", "discover", "debit"),
    validator=luhn_valid,
)
IPV4 = Recognizer("IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.6, ("ip", "ipv4"), hint=".")
IPV6 = Recognizer("IP_ADDRESS", r"\b(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}\b", 0.6, ("ip", "ipv6"), hint=":")
URL = Recognizer("URL", r"\bhttps?://[^\s<>\"']+", 0.6, ("url", "website", "link"), hint="://")
IBAN = Recognizer(
    "IBAN_CODE",
    r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    0.5,
    ("iban", "bank", "transaction"),
    validator=iban_valid,
    ignore_case=False,
)
US_SSN = Recognizer(
    "US_SSN",
    r"\b\d{3}-\d{2}-\d{4}\b",
    0.5,
    ("social", "security", "ssn"),
    validator=ssn_valid,
    hint="-",
)
ISO_DATE = Recognizer("DATE_TIME", rf"\b\d{{4}}-{_MONTH}-{_DAY}\b", 0.6, ("date", "birthday"), hint="-")
SLASH_DATE = Recognizer(
    "DATE_TIME",
    r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:\d{4}|\d{2})\b",
    0.6,
    ("date", "birthday"),
    hint="/",
)

DEFAULT_REGISTRY = (
    CUSTOMER_ID,
    CASE_ID,
    EMAIL,
    INTERNATIONAL_PHONE,
    NATIONAL_PHONE,
    DASHED_PHONE,
    CREDIT_CARD,
    IPV4,
    IPV6,
    URL,
    IBAN,
    US_SSN,
    ISO_DATE,
    SLASH_DATE,
)


def _matches(text: Column, recognizer: Recognizer, number: int) -> Column:
    """What one recognizer sees in a text, for :func:`span_batches.located`, or null."""

    def hit(value: Column, gap: Column) -> Column:
        return F.struct(
            F.lit(number).alias("rule"),
            value.alias("value"),
            F.length(gap).alias("gap"),
            F.coalesce(recognizer.validator(value) if recognizer.validator else F.lit(True), F.lit(False)).alias("valid"),
        )

    def seen(found: Column) -> Column:
        # A single match that occurs once stands where it occurs, and the text is not searched again.
        first = F.get(found, F.lit(0))
        around = [F.octet_length(F.call_function("substring_index", text, first, F.lit(side))) for side in (1, -1)]
        once = (F.size(found) == 1) & (around[0] + F.octet_length(first) + around[1] == F.octet_length(text))
        gaps = F.when(once, F.array().cast("array<string>")).otherwise(F.slice(F.split(text, recognizer.regex, -1), 1, F.size(found)))
        # The inner lambda names none of the outer one's variables: Spark would not find the Python function behind it again.
        return F.when(F.size(found) > 0, F.zip_with(found, gaps, hit))

    found = F.regexp_extract_all(text, F.lit(recognizer.regex), F.lit(0))
    if recognizer.hint:
        found = F.when(F.contains(text, F.lit(recognizer.hint)), found)
    return bind(found, seen)


def _searched(text: Column, registry: tuple[Recognizer, ...], threshold: float | None, with_pieces: bool = False) -> Column:
    """Spans of all recognizers. Matches are found here; their places, the words near them and their scores are worked out batch by
    batch."""
    kind = f"{batches.PIECES_TYPE[:-1]},spans:{sp.SPANS_TYPE}>" if with_pieces else sp.SPANS_TYPE
    rules = [(r.entity_type, *r.scores, frozenset(" ".join(r.context).split(" "))) for r in registry]
    hits = F.flatten(F.filter(F.array(*[_matches(text, r, i) for i, r in enumerate(registry)]), lambda h: h.isNotNull()))
    return F.arrow_udf(batches.located(rules, CONTEXT_WORDS_BEFORE, threshold, with_pieces), kind)(F.make_valid_utf8(text), hits)


def recognize(text: Column, registry: Iterable[Recognizer]) -> Column:
    """All spans of all recognizers, scored, in registry order."""
    registry = tuple(registry)
    return _searched(text, registry, None) if registry else sp.no_spans()


def cut_at_entities(text: Column, registry: Iterable[Recognizer], threshold: float) -> Column:
    """``struct<pieces, tail, spans>``: the entities of :func:`analyze`, and the text cut at them for :func:`spans.rebuilt`."""
    return _searched(text, tuple(registry), float(threshold), with_pieces=True)


def types_held(text: Column, registry: Iterable[Recognizer], threshold: float) -> dict[str, Column]:
    """For each entity type, whether a text holds a match that reaches the threshold.

    A context word only raises a score, so where the score without one suffices, any match decides, and a recognizer whose score
    with one does not suffice is left out. Spans are worked out only for what lies between.
    """
    tests: dict[str, list[Column]] = {}
    near: dict[str, list[Recognizer]] = {}
    for r in registry:
        plain, boosted = r.scores
        tests.setdefault(r.entity_type, [F.lit(False)])
        if plain >= threshold:
            tests[r.entity_type].append(_holds(text, r))
        elif boosted >= threshold:
            near.setdefault(r.entity_type, []).append(r)
    for entity_type, some in near.items():
        tests[entity_type].append(F.exists(recognize(text, some), lambda s: s["score"] >= F.lit(float(threshold))))
    return {t: reduce(or_, some) for t, some in tests.items()}


def _holds(text: Column, recognizer: Recognizer) -> Column:
    """Whether a text holds a match, a valid one if there is a validator; false for a null text."""
    held = text.rlike(recognizer.regex)
    if recognizer.validator:
        found = F.regexp_extract_all(text, F.lit(recognizer.regex), F.lit(0))
        held = F.when(held, F.exists(found, recognizer.validator))
    if recognizer.hint:
        held = F.contains(text, F.lit(recognizer.hint)) & held
    return F.coalesce(held, F.lit(False))


def analyze(
    text: Column,
    registry: Iterable[Recognizer] = DEFAULT_REGISTRY,
    threshold: float = 0.35,
    extra: Iterable[Column] = (),
) -> Column:
    """All entities of a text that reach the threshold, in (start, end, type) order.

    ``extra`` are span arrays from other sources (a dictionary, a model). The empty text has no
    entities; a null text gives null, to be split off as rejected.
    """
    registry, extra = tuple(registry), tuple(extra)
    if registry and not extra:
        return _searched(text, registry, float(threshold))
    found = recognize(text, registry)
    for spans in extra:
        shown = F.transform(
            F.coalesce(spans, sp.no_spans()),
            lambda s: s.withField(
                "text_preview",
                F.coalesce(s["text_preview"], F.substring(text, s["start"] + 1, s["end"] - s["start"])),
            ),
        )
        found = F.concat(found, shown)
    return F.when(text.isNotNull(), sp.settled(found, threshold))
