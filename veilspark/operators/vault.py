"""Identity vault: masked id to original and masked record, with a time to live.

The vault is a Parquet table partitioned by run and ingest date. A run replaces all that it wrote before, on
whatever date, so a repeated run leaves no duplicates, and expiry drops whole partitions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilspark.config import EngineConfig
from veilspark.functions import columns as C, crypto
from veilspark.keyring import KeyRing
from veilspark.operators.lookup import lookup_join
from veilspark.operators.masking import mask_transactions
from veilspark.sources import schemas

MASKED_ID = "masked_id"
STORED_AT = "stored_at"
PREFIX = "id_prefix"


def with_tracking_id(df: DataFrame, keyring: KeyRing, config: EngineConfig, run: str = "") -> DataFrame:
    """Add the repeatable id of each transaction."""
    return df.withColumn(
        MASKED_ID,
        crypto.tracking_id(
            F.col("transaction_id"), keyring.keys(config.mask_version), run, config.tracking_id_bytes
        ),
    )


def vault_rows(
    df: DataFrame, keyring: KeyRing, config: EngineConfig, stored_at: Column, run: str = ""
) -> DataFrame:
    """``(masked_id, original, masked, stored_at)`` of plain transactions; one narrow stage."""
    names = schemas.TRANSACTION.fieldNames()
    tracked = with_tracking_id(df.select(*names), keyring, config, run)
    kept = tracked.select(*names, MASKED_ID, F.struct(*names).alias("original"))
    masked = mask_transactions(kept, keyring, config)
    return masked.select(
        MASKED_ID,
        "original",
        F.struct(*names, "mask_version").alias("masked"),
        stored_at.cast("timestamp").alias(STORED_AT),
    )


def write_vault(
    rows: DataFrame, path: str, run_id: str, prefix_digits: int = 0, refuse_collisions: bool = False
) -> None:
    """Write one run's rows in place of those it wrote before. Files are in the order of ids, so that lookups skip
    row groups.

    ``prefix_digits`` adds one folder for each beginning of an id, evenly filled since ids are hashes, and Bloom filters on ids: a
    lookup then opens the files of one folder. ``refuse_collisions`` raises before anything is written if records share an id.
    """
    if not re.fullmatch(r"[A-Za-z_][\w.-]*", run_id):
        raise ValueError("a run id is a name of letters, digits, '_', '-' and '.'")
    if refuse_collisions and (shared := tracking_id_collisions(rows).first()):
        raise ValueError(f"{shared['records']} records share the id {shared[MASKED_ID]}; take longer ids")
    dated, folders = rows.withColumn("ingest_date", F.to_date(STORED_AT)), ["ingest_date"]
    if prefix_digits:
        folders.append(PREFIX)
        # a letter in front keeps Spark from reading the folder names as numbers
        begins = F.concat(F.lit("p"), F.substring(MASKED_ID, len("MASK-") + 1, prefix_digits))
        dated = dated.withColumn(PREFIX, begins).repartition(*folders)
    (
        dated.sortWithinPartitions(*folders, MASKED_ID)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option(f"parquet.bloom.filter.enabled#{MASKED_ID}", bool(prefix_digits))
        .option("parquet.bloom.filter.adaptive.enabled", True)
        .partitionBy(*folders)
        .parquet(f"{path.rstrip('/')}/run_id={run_id}")
    )


def read_vault(
    spark: SparkSession, path: str, as_of: Column | None = None, ttl_hours: int | None = None
) -> DataFrame:
    """Vault rows, without those older than the time to live at ``as_of``.

    Expiry is strict at lookup; the date filter prunes partitions before any file is opened.
    """
    vault = spark.read.parquet(path)
    if as_of is None:
        return vault
    return live(vault, as_of, ttl_hours)


def live(vault: DataFrame, as_of: Column, ttl_hours: int | None = None) -> DataFrame:
    hours = EngineConfig.vault_ttl_hours if ttl_hours is None else ttl_hours
    oldest = as_of.cast("timestamp") - F.make_interval(hours=F.lit(hours))
    kept = vault.where(F.col(STORED_AT) >= oldest)
    if "ingest_date" in vault.columns:
        kept = kept.where(F.col("ingest_date") >= F.to_date(oldest))
    return kept


def mask_and_track(
    df: DataFrame, path: str, run_id: str, keyring: KeyRing, config: EngineConfig, stored_at: Column
) -> DataFrame:
    """Write the vault, then return ``masked_id`` and the masked columns as read back from it.

    Ids leave only after they are stored, whatever tasks are retried.
    """
    # ids of 16 bytes need no look for collisions, which reads the input once more
    rows = vault_rows(df, keyring, config, stored_at, run_id)
    write_vault(rows, path, run_id, refuse_collisions=config.tracking_id_bytes < 16)
    stored = df.sparkSession.read.parquet(path).where(F.col("run_id") == run_id)
    masked = stored.select(MASKED_ID, "masked.*")
    return schemas.with_schema_classes(masked, schemas.MASKED_TRANSACTION)


def original_of(vault: DataFrame, masked_id: str) -> DataFrame:
    return _row(vault, masked_id).select("original.*")


def masked_of(vault: DataFrame, masked_id: str) -> DataFrame:
    return _row(vault, masked_id).select("masked.*")


def _row(vault: DataFrame, masked_id: str) -> DataFrame:
    found = vault.where(F.col(MASKED_ID) == masked_id)
    if PREFIX not in vault.columns:
        return found
    return found.where(F.startswith(F.lit("p" + masked_id.removeprefix("MASK-")), F.col(PREFIX)))


def restore_identity(predictions: DataFrame, vault: DataFrame, split_hot: bool = True) -> DataFrame:
    """Link scores to the stored identities. Unknown or expired ids drop out; see :func:`unmatched`.

    Only the needed fields of ``original`` are read. An id occurs once in the vault; ``split_hot``
    spreads ids that many predictions name (see ``lookup_join``).
    """
    wanted = ("customer_id", "full_name", "phone", "email", "card_pan", "transaction_id", "amount")
    identities = vault.select(MASKED_ID, *[F.col(f"original.{c}").alias(c) for c in wanted])
    joined = lookup_join(predictions, identities, MASKED_ID, "inner", split_hot)
    return joined.select(
        MASKED_ID,
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
    )


def unmatched(predictions: DataFrame, vault: DataFrame) -> DataFrame:
    """Predictions whose id is unknown or expired."""
    return predictions.join(vault.select(MASKED_ID), MASKED_ID, "left_anti")


def tracking_id_collisions(vault: DataFrame) -> DataFrame:
    """Ids that several records share, with how many: none as long as ids are unique."""
    counts = vault.groupBy(MASKED_ID).agg(F.countDistinct("original.transaction_id").alias("records"))
    return counts.where("records > 1")


def expired_dates(spark: SparkSession, path: str, as_of: str, ttl_hours: int) -> DataFrame:
    """Runs and ingest dates that hold only expired rows, for the storage layer to remove.

    The date is a partition value, so no data column is read.
    """
    oldest = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(ttl_hours))
    dates = spark.read.parquet(path).select("run_id", "ingest_date").distinct()
    return dates.where(F.col("ingest_date") < F.to_date(oldest))
