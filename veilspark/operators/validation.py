"""Row validation: every rule is a boolean column, and rows are split rather than a job failed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.config import CHANNEL_MAP
from veilspark.sources import schemas

VIOLATIONS = "violations"

_TIME = r"(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?"
_OFFSET = r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"
_ISO_TIMESTAMP = rf"^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})(?:.{_TIME}{_OFFSET})?\z"


def is_iso_timestamp(value: Column) -> Column:
    """Whether a string is an ISO-8601 date or timestamp, in extended or basic form.

    Week dates (``2026-W04-2``) are not accepted.
    """
    digits = F.replace(value, F.lit("-"), F.lit(""))
    day = F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd"))
    return F.when(value.isNotNull(), value.rlike(_ISO_TIMESTAMP) & day.isNotNull())


def event_time(value: Column) -> Column:
    """Timestamp of an ISO string for watermarks; the string itself is kept, as it is tokenized verbatim."""
    basic = r"^(\d{4})(\d{2})(\d{2})(?=$|\D)"
    spread = F.regexp_replace(value, basic, "$1-$2-$3")
    clock = F.regexp_replace(spread, r"^(.{10}.\d{2})(\d{2})(\d{2})?", "$1:$2:$3")
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(spread), F.try_to_timestamp(clock))


def transaction_rules() -> dict[str, Column]:
    rules = {f"{f.name}_required": F.col(f.name).isNotNull() for f in schemas.TRANSACTION.fields}
    return rules | {
        "mcc_range": F.col("mcc").between(0, 9999),
        "currency_length": F.length("currency") == 3,
        "amount_not_negative": (F.col("amount") >= 0) & ~F.isnan("amount"),
        "credit_limit_not_negative": (F.col("credit_limit") >= 0) & ~F.isnan("credit_limit"),
        "timestamp_parseable": is_iso_timestamp(F.col("transaction_ts")),
        "channel_known": F.col("channel").isin(list(CHANNEL_MAP)),
    }


def customer_rules() -> dict[str, Column]:
    return {f"{f.name}_required": F.col(f.name).isNotNull() for f in schemas.CUSTOMER.fields}


def prediction_rules() -> dict[str, Column]:
    return {
        "masked_id_required": F.col("masked_id").isNotNull(),
        "score_range": F.col("fraud_probability").between(0, 1),
    }


def text_rules(text_col: str = "text") -> dict[str, Column]:
    """A null text is rejected; the empty text is valid and has no entities."""
    return {"text_required": F.col(text_col).isNotNull()}


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``, the names of the rules a row breaks, in rule order.

    A rule other than "required" holds for null, so one missing value is reported once.
    """
    broken = [
        F.when(~rule, F.lit(name)) if name.endswith("_required")
        else F.when(~F.coalesce(rule, F.lit(True)), F.lit(name))
        for name, rule in rules.items()
    ]
    return df.withColumn(VIOLATIONS, F.array_compact(F.array(*broken)))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``. Both read the input; to write both in one pass, see ``sinks.write_split``."""
    bad = F.size(VIOLATIONS) > 0
    return validated.where(~bad).drop(VIOLATIONS), validated.where(bad)
