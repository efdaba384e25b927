"""Sinks. Masked data is written only behind the egress guard; rejected rows go to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from veilspark.operators import egress, validation
from veilspark.sources import schemas


def write_guarded(df: DataFrame, path: str, destination: str, mode: str = "append") -> None:
    """Write rows that hold no plaintext; the job fails on the first that does."""
    egress.guard(df, destination, "fail").write.mode(mode).parquet(path)


def _separate(*roots: str) -> None:
    one, other = (f"{root.rstrip('/')}/" for root in roots)
    if one.startswith(other) or other.startswith(one):
        raise ValueError("released and rejected rows need separate roots")


def write_routed(rows: DataFrame, path: str, quarantine: str, reason: str = "blocked", mode: str = "append") -> dict[str, int]:
    """Write rows without a reason to ``path``, less that column, and the others to ``quarantine``; return how many went where.

    Works on the jobs that explain. The rows are kept between the two writes, and the counts are taken while they are written.
    """
    _separate(path, quarantine)
    counts = {}
    kept = rows.persist()
    try:
        clear = F.col(reason).isNull()
        for name, side, root in (("passed", kept.where(clear).drop(reason), path), ("blocked", kept.where(~clear), quarantine)):
            seen = Observation()
            side.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(root)
            counts[name] = seen.get["n"]
    finally:
        kept.unpersist()
    return counts


def write_split(validated: DataFrame, path: str, quarantine: str, mode: str = "append") -> None:
    """Write valid rows to ``path`` and rejected ones, with their violations, to ``quarantine``.

    Works on the output of ``validation.validate`` and of ``egress.report``. The rows are kept between the two
    writes, so that the checks run once. Neither root may lie in the other: rejected rows may be plain.
    """
    _separate(path, quarantine)
    bad = F.size(validation.VIOLATIONS) > 0
    kept = validated.persist()
    try:
        kept.where(~bad).drop(validation.VIOLATIONS).write.mode(mode).parquet(path)
        kept.where(bad).write.mode(mode).parquet(quarantine)
    finally:
        kept.unpersist()


def masked_output(df: DataFrame, customers: bool = False) -> DataFrame:
    """Columns and classes of the masked transaction or customer sink."""
    schema = schemas.MASKED_CUSTOMER if customers else schemas.MASKED_TRANSACTION
    return schemas.with_schema_classes(df.select(*schema.fieldNames()), schema)


def cloud_features(masked: DataFrame) -> DataFrame:
    """The nine columns a scoring service may see. Unused cipher columns are never computed."""
    names = schemas.CLOUD_FEATURES.fieldNames()
    return schemas.with_schema_classes(masked.select(*names), schemas.CLOUD_FEATURES)
