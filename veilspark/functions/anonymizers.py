"""What replaces a detected span: one small column function per operator, chosen by entity type."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F

from veilspark.functions import crypto
from veilspark.functions.tokens import wrap_token

Operator = Callable[[Column], Column]

# Placeholders and the entity types that are starred out.
PLACEHOLDERS = {
    "PERSON": "<PERSON>",
    "EMAIL_ADDRESS": "<EMAIL_ADDRESS>",
    "PHONE_NUMBER": "<PHONE_NUMBER>",
    "CREDIT_CARD": "<CREDIT_CARD>",
    "LOCATION": "<LOCATION>",
    "CUSTOMER_ID": "<CUSTOMER_ID>",
    "CASE_ID": "<CASE_ID>",
}
DEFAULT_PLACEHOLDER = "<PII>"
STARRED = ("PHONE_NUMBER", "EMAIL_ADDRESS", "PERSON")
STARRED_CHARACTERS = 100
MODES = ("replace", "mask", "redact")


def replace_with(placeholder: str) -> Operator:
    return lambda value: F.lit(placeholder)


def mask_with(character: str = "*", count: int | None = STARRED_CHARACTERS, from_end: bool = False) -> Operator:
    """Cover ``count`` characters (all if None) from one end; the rest stays."""

    def operate(value: Column) -> Column:
        length = F.length(value)
        covered = length if count is None else F.least(length, F.lit(count))
        stars = F.repeat(F.lit(character), covered)
        if from_end:
            return F.concat(F.substring(value, F.lit(1), length - covered), stars)
        return F.concat(stars, F.substring(value, covered + 1, length))

    return operate


def redact() -> Operator:
    return lambda value: F.lit("")


def hash_with(salt: str) -> Operator:
    if not salt:
        raise ValueError("hashing needs a salt")
    return lambda value: short_hash(value, salt)


def short_hash(value: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)
    return F.concat(F.lit("[redacted:"), F.substring(digest, 1, 12), F.lit("]"))


def tokenize_with(entity_type: str, version: str, keys: Column, domain: str) -> Operator:
    """Reversible form: an encrypted token whose field is the entity type."""
    field, at = F.lit(entity_type), F.lit(version)
    return lambda value: wrap_token(field, at, crypto.encrypt(value, field, at, keys, domain))


def operators_for(mode: str, mask_all: bool = False) -> tuple[dict[str, Operator], Operator]:
    """Operator per entity type, and the default one, of a mode."""
    if mode == "replace":
        return {t: replace_with(p) for t, p in PLACEHOLDERS.items()}, replace_with(DEFAULT_PLACEHOLDER)
    if mode == "mask":
        stars = mask_with(count=None if mask_all else STARRED_CHARACTERS)
        return {t: stars for t in STARRED}, replace_with(DEFAULT_PLACEHOLDER)
    if mode == "redact":
        return {}, redact()
    raise ValueError(f"mode must be one of {', '.join(MODES)}")


def by_entity(operators: Mapping[str, Operator], default: Operator) -> Callable[[Column, Column], Column]:
    """Choose the operator of a span by its entity type."""

    def choose(entity_type: Column, value: Column) -> Column:
        chosen = None
        for name, operate in operators.items():
            match = entity_type == F.lit(name)
            chosen = F.when(match, operate(value)) if chosen is None else chosen.when(match, operate(value))
        return default(value) if chosen is None else chosen.otherwise(default(value))

    return choose
