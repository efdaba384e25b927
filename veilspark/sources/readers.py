"""Typed sources. A field that does not fit its type makes a rejected row, never a silent null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veilspark.sources import schemas

TYPE_ERRORS = "type_errors"

# Texts accepted as booleans.
_TRUE = ("true", "t", "yes", "y", "on", "1")
_FALSE = ("false", "f", "no", "n", "off", "0")


def _typed(value: Column, kind: Column, data_type: T.DataType) -> Column:
    """Convert a JSON value leniently: numeric and boolean texts are accepted, numbers are not texts."""
    text = F.try_variant_get(value, "$", "string")
    if isinstance(data_type, T.StringType):
        return F.when(kind == "STRING", text)
    if isinstance(data_type, T.BooleanType):
        word = F.lower(text)
        return F.when(word.isin(*_TRUE), True).when(word.isin(*_FALSE), False)
    number = F.when(kind != "BOOLEAN", F.trim(text).try_cast("double"))
    if isinstance(data_type, T.IntegerType):
        return F.when(number == F.floor(number), number.try_cast("int"))
    return number.cast(data_type)


def parse_json(df: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """Parse one JSON record per row into ``schema``.

    Adds ``type_errors``: fields that are present but do not fit, or ``record`` if the text is not a
    JSON object. Missing fields are null and left to the "required" rules.
    """
    record = F.try_parse_json(F.col(json_col))
    parsed = df.withColumn("_record", record)
    raw = parsed.select(
        *[c for c in df.columns if c != json_col],
        F.col("_record"),
        *[
            F.try_variant_get("_record", f"$.{f.name}", "variant").alias(f"_{f.name}")
            for f in schema.fields
        ],
    )
    typed, errors = [], [
        F.when(
            F.col("_record").isNull() | ~F.schema_of_variant("_record").startswith("OBJECT"), "record"
        )
    ]
    for f in schema.fields:
        value = F.col(f"_{f.name}")
        # an explicit JSON null is the same as a missing field
        present = value.isNotNull() & ~F.is_variant_null(value)
        converted = F.when(present, _typed(value, F.schema_of_variant(value), f.dataType))
        typed.append(converted.alias(f.name, metadata=f.metadata))
        errors.append(F.when(present & converted.isNull(), f.name))
    return raw.select(
        *[c for c in df.columns if c != json_col],
        *typed,
        F.array_compact(F.array(*errors)).alias(TYPE_ERRORS),
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast columns of a table or stream to ``schema``, attach data classes and list misfits.

    A number is no text, and a number with a fraction is no whole number.
    """
    errors, columns = [], []
    for f in schema.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        source = df.schema[f.name].dataType if f.name in df.columns else T.NullType()
        converted = value.try_cast(f.dataType)
        if isinstance(f.dataType, T.StringType) and isinstance(source, (T.NumericType, T.BooleanType)):
            converted = F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.IntegralType) and isinstance(source, (T.FractionalType, T.DecimalType)):
            converted = F.when(value == F.floor(value), converted)
        columns.append(converted.alias(f.name, metadata=f.metadata))
        errors.append(F.when(value.isNotNull() & converted.isNull(), f.name))
    return df.select(*columns, F.array_compact(F.array(*errors)).alias(TYPE_ERRORS))


def read_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Records from files: JSON lines are parsed leniently, other formats are conformed."""
    if fmt == "json":
        return parse_json(spark.read.text(path), "value", schema)
    return conform(spark.read.format(fmt).load(path), schema)


def read_record_stream(
    spark: SparkSession, path: str, schema: T.StructType, source: T.StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """As :func:`read_records` for a stream of files with the physical schema ``source``."""
    return conform(spark.readStream.schema(source).options(**options).format(fmt).load(path), schema)


def text_source(df: DataFrame, text_col: str = "text", language_col: str | None = None) -> DataFrame:
    """Add ``language``, English unless a column says otherwise."""
    language = F.coalesce(F.col(language_col), F.lit("en")) if language_col else F.lit("en")
    return df.withColumn("language", language)


def text_with_replacements(df: DataFrame, text_col: str, fields: dict[str, str]) -> DataFrame:
    """``(text, replacements)`` rows: for each token field, the column whose value is to be hidden."""
    pairs = [
        F.struct(F.lit(name).alias("key"), F.col(column).cast("string").alias("value"))
        for name, column in fields.items()
    ]
    return df.withColumn("text", F.col(text_col)).withColumn("replacements", F.array(*pairs))


def prediction_source(df: DataFrame) -> DataFrame:
    """Predictions with the default model version filled in."""
    version = F.col("model_version") if "model_version" in df.columns else F.lit(None).cast("string")
    return schemas.with_schema_classes(
        df.select(
            F.col("masked_id"),
            F.col("fraud_probability").cast("double").alias("fraud_probability"),
            F.coalesce(version, F.lit(schemas.DEFAULT_MODEL_VERSION)).alias("model_version"),
        ),
        schemas.PREDICTION,
    )
