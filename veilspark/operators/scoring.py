"""Scores, optional customer profiles and the decision record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.functions import columns as C
from veilspark.operators.lookup import lookup_join
from veilspark.sources import schemas

# The constant score and reasons used when no model is given.
CONSTANT_SCORE = 0.75
CONSTANT_REASONS = ("DEVICE_NEW", "AMOUNT_SPIKE", "GEO_MISMATCH")


def attach_scores(
    df: DataFrame,
    scorer: Column | DataFrame | None = None,
    reasons: Column | None = None,
    key: str = "masked_id",
    split_hot: bool = True,
) -> DataFrame:
    """Add ``fraud_probability`` and ``reason_codes``.

    ``scorer`` is a column (an expression or a pandas UDF call), a predictions table with a unique
    ``key``, or nothing for the constant. Rows without a prediction keep a null score.
    """
    codes = F.array(*map(F.lit, CONSTANT_REASONS)) if reasons is None else reasons
    if isinstance(scorer, DataFrame):
        columns = [c for c in (key, "fraud_probability", "reason_codes") if c in scorer.columns]
        joined = lookup_join(df, scorer.select(*columns), key, "left", split_hot)
        return joined if "reason_codes" in columns else joined.withColumn("reason_codes", codes)
    score = F.lit(CONSTANT_SCORE) if scorer is None else scorer
    return df.withColumn("fraud_probability", score.cast("double")).withColumn("reason_codes", codes)


def cloud_predictions(features: DataFrame, scorer: Column | None = None) -> DataFrame:
    """``(masked_id, fraud_probability, model_version)`` for cloud features."""
    score = F.lit(CONSTANT_SCORE) if scorer is None else scorer
    scored = features.select(
        "masked_id",
        score.cast("double").alias("fraud_probability"),
        F.lit(schemas.DEFAULT_MODEL_VERSION).alias("model_version"),
    )
    return schemas.with_schema_classes(scored, schemas.PREDICTION)


def with_profile(transactions: DataFrame, customers: DataFrame, split_hot: bool = True) -> DataFrame:
    """Left join the customer profile as struct ``customer``, null where there is none.

    One customer may own a large share of all transactions: its rows are spread (see
    ``lookup_join``). ``customers`` has each ``customer_id`` once.
    """
    names = schemas.CUSTOMER.fieldNames()
    profiles = customers.select("customer_id", F.struct(*names).alias("customer"))
    return lookup_join(transactions, profiles, "customer_id", "left", split_hot)


def contact(df: DataFrame) -> dict[str, Column]:
    """Name, phone, email and address: all from the profile if there is one, else all from the
    transaction. The choice is per record, so a null in a profile is not filled in."""
    present = F.col("customer").isNotNull()

    def pick(profile_field: str, own_field: str) -> Column:
        return F.when(present, F.col(f"customer.{profile_field}")).otherwise(F.col(own_field))

    return {
        "full_name": pick("full_name", "full_name"),
        "phone": pick("phone", "phone"),
        "email": pick("email", "email"),
        "address": pick("address", "billing_address"),
    }


def decision_record(
    df: DataFrame, token_customer_id: Column, scored_at: Column, name: str = "_fraud_scoring"
) -> DataFrame:
    """Original columns plus the scoring struct. It holds plain values: internal use only.

    ``scored_at`` is an argument, so that a repeated run gives the same rows.
    """
    stamp = F.date_format(scored_at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.withColumn(
        name,
        F.struct(
            token_customer_id.alias("token_customer_id"),
            F.col("fraud_probability").alias("fraud_probability"),
            F.col("reason_codes").alias("reason_codes"),
            C.risk_level(F.col("fraud_probability")).alias("risk_level"),
            stamp.alias("scoring_timestamp"),
        ),
    )
