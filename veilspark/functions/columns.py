"""Numeric, categorical and rendering expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def settled(value: Column) -> Column:
    """The same value, computed where it stands.

    The optimizer moves filters on a computed column below the projection and repeats its expression
    there. For costly columns that are filtered on, a branch on the partition number, which is never
    negative, keeps it in place.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def scale(value: Column, factor: float) -> Column:
    return value * F.lit(float(factor))


def unscale(value: Column, factor: float, round_to: int | None = None) -> Column:
    """Divide by the factor. ``(x * s) / s`` may differ from ``x`` in the last bit; ``round_to`` settles it."""
    plain = value / F.lit(float(factor))
    return plain if round_to is None else F.round(plain, round_to)


def map_category(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace mapped values; others pass through."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def invert(mapping: Mapping[str, str]) -> dict[str, str]:
    inverse = {masked: plain for plain, masked in mapping.items()}
    if len(inverse) != len(mapping):
        raise ValueError("the mapping is not one-to-one")
    return inverse


def permute(value: Column, arrangement: Column) -> Column:
    """Look an integer up in a permutation array; null outside its domain."""
    return F.get(arrangement, value)


def last_four(card_number: Column) -> Column:
    return F.right(card_number, F.lit(4))


def fixed_decimals(value: Column, places: int) -> Column:
    """Render with a fixed number of decimals, ties to even on the binary value."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places if places else "0"))


def percent(value: Column) -> Column:
    return F.concat(fixed_decimals(value * F.lit(100.0), 0), F.lit("%"))


def _plain_digits(value: Column) -> Column:
    """Text of a double without an exponent.

    Whole numbers keep ``.0`` below 1e16, as shortest-form rendering does.
    """
    text = value.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.ltrim(F.substring_index(text, "E", 1), F.lit("-"))
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=\d)0+$", "")
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, "0")
    fraction = F.substring(digits, exponent + 2, F.length(digits))
    large = F.concat(
        whole,
        F.when(fraction != "", F.concat(F.lit("."), fraction))
        .when(exponent < 16, ".0")
        .otherwise(""),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return F.when(
        text.contains("E"), F.concat(sign, F.when(exponent >= 0, large).otherwise(small))
    ).otherwise(text)


def canonical_text(value: Column, data_type: str) -> Column:
    """Text form of a value before it is tokenized; null becomes the empty string."""
    if data_type == "boolean":
        raise ValueError("booleans have no canonical text")
    if data_type in ("double", "float"):
        return F.coalesce(_plain_digits(value.cast("double")), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


# Banding edges and texts.
REVIEW_FROM = 0.3
DECLINE_FROM = 0.7
APPROVE = "APPROVE - Low risk transaction"
REVIEW = "REVIEW - Medium risk, manual review recommended"
DECLINE = "DECLINE - High risk, potential fraud"


def recommendation(probability: Column) -> Column:
    return (
        F.when(probability < REVIEW_FROM, APPROVE)
        .when(probability < DECLINE_FROM, REVIEW)
        .when(probability.isNotNull(), DECLINE)
    )


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability >= DECLINE_FROM, "HIGH")
        .when(probability >= REVIEW_FROM, "MEDIUM")
        .when(probability.isNotNull(), "LOW")
    )
