"""Record schemas. Each field carries its data class as column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

CLASSES = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "PII", "PCI")
DEFAULT_CLASS = "INTERNAL"
KEY = "classification"

_STR, _INT, _DBL, _BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def field(name: str, data_type: T.DataType, data_class: str, nullable: bool = True) -> T.StructField:
    if data_class not in CLASSES:
        raise ValueError(f"unknown data class: {data_class}")
    return T.StructField(name, data_type, nullable, {KEY: data_class})


# Field names, types and data classes of the records.
TRANSACTION = T.StructType(
    [
        field("transaction_id", _STR, "INTERNAL"),
        field("transaction_ts", _STR, "CONFIDENTIAL"),
        field("customer_id", _STR, "PII"),
        field("full_name", _STR, "PII"),
        field("phone", _STR, "PII"),
        field("email", _STR, "PII"),
        field("billing_address", _STR, "PII"),
        field("card_pan", _STR, "PCI"),
        field("card_expiry", _STR, "PCI"),
        field("ip_address", _STR, "PII"),
        field("device_id", _STR, "PII"),
        field("merchant_id", _STR, "CONFIDENTIAL"),
        field("merchant_name", _STR, "CONFIDENTIAL"),
        field("mcc", _INT, "INTERNAL"),
        field("merchant_country", _STR, "INTERNAL"),
        field("terminal_id", _STR, "CONFIDENTIAL"),
        field("channel", _STR, "INTERNAL"),
        field("currency", _STR, "INTERNAL"),
        field("amount", _DBL, "CONFIDENTIAL"),
        field("available_balance", _DBL, "CONFIDENTIAL"),
        field("credit_limit", _DBL, "CONFIDENTIAL"),
        field("is_card_present", _BOOL, "INTERNAL"),
    ]
)
MASK_VERSION = field("mask_version", _STR, "INTERNAL")
MASKED_TRANSACTION = T.StructType([*TRANSACTION.fields, MASK_VERSION])

CUSTOMER = T.StructType(
    [
        field("customer_id", _STR, "PII"),
        field("full_name", _STR, "PII"),
        field("phone", _STR, "PII"),
        field("email", _STR, "PII"),
        field("address", _STR, "PII"),
        field("kyc_segment", _STR, "CONFIDENTIAL"),
        field("preferred_language", _STR, "INTERNAL"),
    ]
)
MASKED_CUSTOMER = T.StructType([*CUSTOMER.fields, MASK_VERSION])

CLOUD_FEATURES = T.StructType(
    [
        field("masked_id", _STR, "CONFIDENTIAL"),
        field("mcc", _INT, "INTERNAL"),
        field("channel", _STR, "INTERNAL"),
        field("currency", _STR, "INTERNAL"),
        field("amount", _DBL, "CONFIDENTIAL"),
        field("available_balance", _DBL, "CONFIDENTIAL"),
        field("credit_limit", _DBL, "CONFIDENTIAL"),
        field("is_card_present", _BOOL, "INTERNAL"),
        field("merchant_country", _STR, "INTERNAL"),
    ]
)
DEFAULT_MODEL_VERSION = "fraud-detector-v2.1"
PREDICTION = T.StructType(
    [
        field("masked_id", _STR, "CONFIDENTIAL"),
        field("fraud_probability", _DBL, "CONFIDENTIAL"),
        field("model_version", _STR, "INTERNAL"),
    ]
)
TOKEN_CLASSES = {
    "customer_name": "PII",
    "customer_phone": "PII",
    "customer_email": "PII",
    "amount": "CONFIDENTIAL",
    "merchant_name": "CONFIDENTIAL",
    "transaction_ts": "CONFIDENTIAL",
    "fraud_probability": "CONFIDENTIAL",
}
TOKEN_CONTEXT = T.StructType([field(f"{n}_token", _STR, c) for n, c in TOKEN_CLASSES.items()])
PROMPT = T.StructType(
    [
        field("prompt_version", _STR, "INTERNAL"),
        field("context", TOKEN_CONTEXT, "INTERNAL"),
        field("reason_codes", T.ArrayType(_STR), "INTERNAL"),
    ]
)
TOKEN = T.StructType([field("field", _STR, "INTERNAL"), field("token", _STR, "PII")])
MASKED_REQUEST = T.StructType(
    [
        field("prompt", _STR, "INTERNAL"),
        field("tokens", T.ArrayType(TOKEN), "PII"),
        field("reason_codes", T.ArrayType(_STR), "INTERNAL"),
    ]
)


def classes_of(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.metadata.get(KEY, DEFAULT_CLASS) for f in schema.fields}


def declared_classes(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.metadata[KEY] for f in schema.fields if KEY in f.metadata}


def with_classes(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Attach data classes. Expressions drop column metadata, so operators call this last."""
    unknown = set(classes.values()) - set(CLASSES)
    if unknown:
        raise ValueError(f"unknown data classes: {sorted(unknown)}")
    return df.select(
        *[
            F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, KEY: classes[f.name]})
            if f.name in classes
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def with_schema_classes(df: DataFrame, schema: T.StructType) -> DataFrame:
    return with_classes(df, classes_of(schema))
