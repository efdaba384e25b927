"""Tables written on the way, and columns that cannot clash with those of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilspark.sources.storage import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to a new shared folder and read back: no lineage, no second computation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Texts that travel to a Python worker at a time; the default of the session is made for short rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of what travels between the JVM and Python workers, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def whole(text: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def with_results(df: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """Adds the fields of a struct as columns; an input column of the same name is replaced."""
    inner = fresh("result", df)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in fields]
    return df.withColumn(inner, result).select(*kept, *(F.col(inner)[f].alias(f) for f in fields))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
