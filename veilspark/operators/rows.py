"""Rows from array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def one_row_each(df: DataFrame, array_col: str, keep: tuple[str, ...], name: str) -> DataFrame:
    """Explode a computed array.

    A plain ``explode`` lets the optimizer infer ``size(array) > 0`` and push it towards the scan,
    which repeats the array's whole expression there. Exploding with outer rows and dropping those
    computes the array once.
    """
    return df.select(*keep, F.explode_outer(array_col).alias(name)).where(F.col(name).isNotNull())
