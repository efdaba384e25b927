"""The same operators on streams, plus the score-to-identity join and guarded sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilspark.config import EngineConfig, MaskPolicy
from veilspark.functions import columns as C
from veilspark.functions.recognizers import DEFAULT_REGISTRY, Recognizer
from veilspark.keyring import KeyRing
from veilspark.operators import egress, masking, text
from veilspark.sources import sinks


def mask_stream(stream: DataFrame, policy: MaskPolicy, keyring: KeyRing, config: EngineConfig) -> DataFrame:
    """Stateless: the batch projection runs on each micro-batch."""
    return masking.mask(stream, policy, keyring, config)


def anonymize_stream(
    stream: DataFrame, text_col: str = "text", mode: str = "replace",
    registry: Iterable[Recognizer] = DEFAULT_REGISTRY, config: EngineConfig = EngineConfig(),
) -> DataFrame:
    """Stateless detection and replacement."""
    return text.anonymize(stream, text_col, mode, registry, config=config)


def restore_stream(
    predictions: DataFrame,
    vault: DataFrame,
    predicted_at: str = "predicted_at",
    stored_at: str = "stored_at",
    ttl_hours: int = EngineConfig.vault_ttl_hours,
    lateness: str = "10 minutes",
    how: str = "leftOuter",
) -> DataFrame:
    """Join scores to vault rows stored up to ``ttl_hours`` before them.

    Both sides are watermarked, so state is dropped once the interval has passed. With ``leftOuter``
    a score without a vault row comes out with ``matched = false``, but only after later events have
    moved the watermark beyond its interval. Replays give no second result: an equal score is dropped, and so is a vault row
    whose id was stored within ``lateness`` before; what is later than the watermark is dropped anyway.
    """
    left = predictions.select(
        F.col("masked_id").alias("_id"), "fraud_probability", "model_version", predicted_at
    ).withWatermark(predicted_at, lateness)
    left = left.dropDuplicatesWithinWatermark(left.columns)
    wanted = ("customer_id", "full_name", "phone", "email", "card_pan", "transaction_id", "amount")
    right = vault.select(
        "masked_id", stored_at, *[F.col(f"original.{c}").alias(c) for c in wanted]
    ).withWatermark(stored_at, lateness).dropDuplicatesWithinWatermark(["masked_id"])
    in_time = (F.col(predicted_at) >= F.col(stored_at)) & (
        F.col(predicted_at) <= F.col(stored_at) + F.make_interval(hours=F.lit(ttl_hours))
    )
    joined = left.join(right, (F.col("_id") == F.col("masked_id")) & in_time, how)
    return joined.select(
        F.col("_id").alias("masked_id"),
        "fraud_probability",
        "model_version",
        "customer_id",
        "full_name",
        "phone",
        "email",
        C.last_four(F.col("card_pan")).alias("card_pan_last4"),
        "transaction_id",
        F.col("amount").alias("amount_original"),
        C.recommendation(F.col("fraud_probability")).alias("recommendation"),
        F.col("masked_id").isNotNull().alias("matched"),
        predicted_at,
    )


def guarded_writer(
    stream: DataFrame, destination: str, path: str, quarantine: str, checkpoint: str, **options
) -> DataStreamWriter:
    """Write passing rows to ``path`` and others, with their violations, to ``quarantine``, a separate root.

    Each batch replaces its own ``batch_id`` folder on both sides, empty or not, so a replayed batch leaves no
    duplicates and no row on the side it no longer belongs to.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = egress.report(batch, destination, **options)
        folders = (f"{root.rstrip('/')}/batch_id={batch_id}" for root in (path, quarantine))
        sinks.write_split(checked, *folders, mode="overwrite")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def file_writer(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to Parquet; the sink's commit log makes replays exact."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
