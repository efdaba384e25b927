"""Classification, the egress guard, the plaintext-leak check and log redaction.

Data classes come from column metadata. The schema is walked once on the driver and becomes one
column expression per row; no data is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilspark.functions import crypto, tokens
from veilspark.functions.anonymizers import short_hash
from veilspark.functions.columns import canonical_text, fixed_decimals, settled
from veilspark.functions.crypto import bind
from veilspark.sources import schemas

VIOLATIONS = "violations"
VIOLATION_TYPE = "struct<path:string,classification:string,rule:string>"

# Classes each destination must not see in plain.
GUARDED = {"cloud": ("PII", "PCI"), "llm": ("PII", "PCI", "CONFIDENTIAL")}
RULES = {"cloud": "must be masked ciphertext", "llm": "must be ENC token"}


class EgressViolation(ValueError):
    """Raised at plan time when a schema can never pass."""


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION_TYPE}>")


def _violation(path: Column, data_class: str, destination: str) -> Column:
    return F.struct(
        path.alias("path"),
        F.lit(data_class).alias("classification"),
        F.lit(RULES[destination]).alias("rule"),
    )


def _holds(value: Column, data_type: T.DataType, destination: str, authentic) -> Column:
    if not isinstance(data_type, T.StringType):
        return F.lit(False)
    if destination == "llm":
        return tokens.is_enc_token(value)
    shaped = crypto.is_ciphertext(value)
    return shaped & authentic(value) if authentic else shaped


def _leaf_violations(
    value: Column, data_type: T.DataType, data_class: str, path: Column, destination: str,
    classes: dict[str, str], name: str, authentic,
) -> Column | None:
    """Violations below one field as an array, or None if nothing there is guarded."""
    if isinstance(data_type, T.StructType):
        found = [
            _leaf_violations(
                value[f.name], f.dataType, _class_of(f, f"{name}.{f.name}", classes),
                F.concat(path, F.lit(f".{f.name}")), destination, classes, f"{name}.{f.name}", authentic,
            )
            for f in data_type.fields
        ]
        found = [v for v in found if v is not None]
        return F.concat(*found) if found else None
    if isinstance(data_type, T.ArrayType):
        if data_class not in GUARDED[destination] and not _guards_inside(data_type.elementType, destination, classes, name):
            return None
        if _record(data_type.elementType) and not _guards_inside(data_type.elementType, destination, classes, name):
            return None
        return F.coalesce(
            F.flatten(
                F.transform(
                    value,
                    lambda item, i: _leaf_violations(
                        item, data_type.elementType, data_class,
                        F.concat(path, F.lit("["), i.cast("string"), F.lit("]")),
                        destination, classes, name, authentic,
                    ),
                )
            ),
            _none(),
        )
    if isinstance(data_type, T.MapType):
        # A record's own fields decide, whatever the class of the map; keys are of the map's class. A key that must be
        # masked is named by its place, so that the report does not show it.
        guarded = data_class in GUARDED[destination]

        def entry_violations(entry: Column, i: Column) -> Column | None:
            shown = F.concat(F.lit("{"), i.cast("string"), F.lit("}")) if guarded else F.concat(F.lit("."), entry["key"].cast("string"))
            inside = _leaf_violations(
                entry["value"], data_type.valueType, data_class, F.concat(path, shown), destination, classes, name, authentic
            )
            if not guarded:
                return inside
            key = _leaf_violations(
                entry["key"], data_type.keyType, data_class, F.concat(path, shown, F.lit(".key")), destination, classes, name, authentic
            )
            return F.concat(*(v for v in (key, inside) if v is not None))

        if not guarded and not _guards_inside(data_type.valueType, destination, classes, name):
            return None
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), entry_violations)), _none())
    if data_class not in GUARDED[destination]:
        return None
    bad = value.isNotNull() & ~_holds(value, data_type, destination, authentic)
    return F.when(bad, F.array(_violation(path, data_class, destination))).otherwise(_none())


def _record(data_type: T.DataType) -> T.StructType | None:
    """The record inside arrays and map values, if any."""
    while isinstance(data_type, (T.ArrayType, T.MapType)):
        data_type = data_type.elementType if isinstance(data_type, T.ArrayType) else data_type.valueType
    return data_type if isinstance(data_type, T.StructType) else None


def _guards_inside(data_type: T.DataType, destination: str, classes: dict[str, str], name: str) -> bool:
    """Whether any field of the record inside is of a guarded class."""
    record = _record(data_type)
    return bool(record) and any(
        _guards_inside(f.dataType, destination, classes, f"{name}.{f.name}")
        if isinstance(f.dataType, T.StructType)
        else _class_of(f, f"{name}.{f.name}", classes) in GUARDED[destination]
        or _guards_inside(f.dataType, destination, classes, f"{name}.{f.name}")
        for f in record.fields
    )


def _undeclared(fields: list[T.StructField], prefix: str, classes: dict[str, str]) -> list[str]:
    """Fields without a class, at any depth. A record's own class says nothing about its fields."""
    bare = []
    for f in fields:
        name, record = f"{prefix}{f.name}", _record(f.dataType)
        if schemas.KEY not in f.metadata and name not in classes and not (prefix and record):
            bare.append(name)
        bare += _undeclared(record.fields, f"{name}.", classes) if record else []
    return bare


def _class_of(f: T.StructField, name: str, classes: dict[str, str]) -> str:
    """A struct's fields carry their own class; undeclared ones count as INTERNAL."""
    return classes.get(name) or f.metadata.get(schemas.KEY, schemas.DEFAULT_CLASS)


def _checked_classes(
    df: DataFrame, destination: str, classes: dict[str, str] | None, strict: bool
) -> dict[str, str]:
    if destination not in GUARDED:
        raise ValueError("destination must be 'cloud' or 'llm'")
    classes = classes or {}
    if strict:
        if bare := _undeclared(df.schema.fields, "", classes):
            raise EgressViolation(f"columns without a data class: {', '.join(bare)}")
    return classes


def violations(
    df: DataFrame,
    destination: str,
    classes: dict[str, str] | None = None,
    strict: bool = False,
    authentic: Callable[[str], Callable[[Column], Column]] | None = None,
) -> Column:
    """``array<struct<path, classification, rule>>`` of one row, in schema order.

    ``classes`` overrides or supplies classes by dotted name. ``strict`` refuses columns without a
    class instead of treating them as INTERNAL. ``authentic`` adds, per field, a check beyond the
    shape of a ciphertext (see :func:`authentic_with`).
    """
    classes = _checked_classes(df, destination, classes, strict)
    found = [v for _, v in _by_column(df, destination, classes, authentic) if v is not None]
    return F.concat(*found) if found else _none()


def _by_column(df: DataFrame, destination: str, classes: dict[str, str], authentic):
    """Each field with its violations, or None where nothing is guarded."""
    for f in df.schema.fields:
        yield f, _leaf_violations(
            F.col(f"`{f.name}`"), f.dataType, _class_of(f, f.name, classes), F.lit(f.name),
            destination, classes, f.name, authentic(f.name) if authentic else None,
        )


def authentic_with(keys: Column, version: Column, domain: str) -> Callable[[str], Callable[[Column], Column]]:
    """Check that a ciphertext really opens, for the field it stands in."""
    return lambda name: lambda value: crypto.decrypt(value, F.lit(name), version, keys, domain).isNotNull()


def report(df: DataFrame, destination: str, **options) -> DataFrame:
    """Add ``violations`` to every row."""
    return df.withColumn(VIOLATIONS, settled(violations(df, destination, **options)))


def guard(df: DataFrame, destination: str, mode: str = "fail", **options):
    """Stop plaintext from leaving.

    ``fail`` returns the rows; a job that reads a guarded column of them fails at its first violation.
    ``split`` returns ``(passed, quarantined)``, which each read the input; ``report`` returns all rows
    with their violations, and ``sinks.write_split`` writes both sides of that in one pass.
    """
    if mode == "report":
        return report(df, destination, **options)
    if mode == "split":
        checked = report(df, destination, **options)
        bad = F.size(VIOLATIONS) > 0
        return checked.where(~bad).drop(VIOLATIONS), checked.where(bad)
    if mode != "fail":
        raise ValueError("mode must be 'fail', 'split' or 'report'")
    return _fail_on_read(df, destination, **options)


def blocked_message(found: Column, destination: str) -> Column:
    """Text about the first violation, null if there is none."""
    first = F.get(found, F.lit(0))
    return F.concat(
        F.lit(f"{destination} egress blocked: field '"), first["path"], F.lit("' "), first["rule"],
        F.lit(" for "), first["classification"],
    )


def _fail_on_read(
    df: DataFrame, destination: str, classes: dict[str, str] | None = None, strict: bool = False,
    authentic: Callable[[str], Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Let each guarded column check itself when it is read.

    A filter over all columns would be pushed below the projection that masks them, and every value
    would be encrypted twice.
    """
    classes = _checked_classes(df, destination, classes, strict)
    out = []
    for f, found in _by_column(df, destination, classes, authentic):
        value = F.col(f"`{f.name}`")
        if found is not None:
            clean = F.size(found) == 0
            value = crypto.fail_unless(clean, value, blocked_message(found, destination)).alias(
                f.name, metadata=f.metadata
            )
        out.append(value)
    return df.select(*out)


# Fields whose plain text must not occur in a prompt, and the shortest value that counts.
LEAK_TEXT_FIELDS = (
    "customer_id",
    "full_name",
    "phone",
    "email",
    "billing_address",
    "card_pan",
    "card_expiry",
    "ip_address",
    "device_id",
    "merchant_name",
    "transaction_ts",
)
LEAK_NUMERIC_FIELDS = ("amount", "available_balance", "credit_limit")
LEAK_PROFILE_FIELDS = ("customer_id", "full_name", "phone", "email", "address")
LEAK_MINIMUM_LENGTH = 5


def leaked_fields(prompt: Column, record: Column, profile: Column | None = None) -> Column:
    """Names of the fields whose plain value occurs in a prompt, ignoring case.

    ``record`` is a transaction struct and ``profile`` a customer struct or null. Numbers are looked
    for in their shortest and their two-decimal form. A prompt without any token gives ``prompt``.
    """

    def candidate(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))

    candidates = [candidate(f, record[f]) for f in LEAK_TEXT_FIELDS]
    for f in LEAK_NUMERIC_FIELDS:
        shown = F.when(record[f].isNotNull(), canonical_text(record[f], "double"))
        candidates += [candidate(f, shown), candidate(f, fixed_decimals(record[f], 2))]
    if profile is not None:
        candidates += [candidate(f"customer.{f}", profile[f]) for f in LEAK_PROFILE_FIELDS]
    leaks = bind(
        F.lower(prompt),
        lambda haystack: F.filter(
            F.array(*candidates),
            lambda c: (F.length(c["value"]) >= LEAK_MINIMUM_LENGTH)
            & F.contains(haystack, F.lower(c["value"])),
        ),
    )
    untokenized = F.when(~F.contains(prompt, F.lit(tokens.TOKEN_START)), F.array(F.lit("prompt")))
    return F.array_distinct(
        F.concat(
            F.coalesce(untokenized, F.array().cast("array<string>")),
            F.transform(leaks, lambda c: c["field"]),
        )
    )


def redact_for_log(df: DataFrame, salt: str, classes: dict[str, str] | None = None) -> DataFrame:
    """Replace PII and PCI values by a short salted hash, also inside structs, arrays and maps at any depth.

    Null stays null and other classes stay readable. Numbers and booleans become text,
    fractions in the form in which they are tokenized. A container of records is
    opened, and their fields' own classes decide; the keys of a PII or PCI map are replaced as well.
    """
    if not salt:
        raise ValueError("redaction needs a salt")
    classes = classes or {}

    def redact(value: Column, data_type: T.DataType, data_class: str, name: str) -> Column:
        if isinstance(data_type, T.StructType):
            inner = F.struct(
                *[
                    redact(value[f.name], f.dataType, _class_of(f, f"{name}.{f.name}", classes),
                           f"{name}.{f.name}").alias(f.name)
                    for f in data_type.fields
                ]
            )
            return F.when(value.isNotNull(), inner)
        if isinstance(data_type, T.ArrayType) and _record(data_type):
            return F.transform(value, lambda item: redact(item, data_type.elementType, data_class, name))
        if isinstance(data_type, T.MapType) and _record(data_type):
            return F.map_from_entries(
                F.transform(
                    F.map_entries(value),
                    lambda e: F.struct(
                        redact(e["key"], data_type.keyType, data_class, name).alias("key"),
                        redact(e["value"], data_type.valueType, data_class, name).alias("value"),
                    ),
                )
            )
        if data_class not in ("PII", "PCI"):
            return value
        if isinstance(data_type, (T.ArrayType, T.MapType)):
            return short_hash(F.to_json(value), salt)
        if isinstance(data_type, (T.DoubleType, T.FloatType)):
            return F.when(value.isNotNull(), short_hash(canonical_text(value, "double"), salt))
        return short_hash(value, salt)

    return df.select(
        *[
            redact(F.col(f"`{f.name}`"), f.dataType, _class_of(f, f.name, classes), f.name).alias(
                f.name, metadata=f.metadata
            )
            for f in df.schema.fields
        ]
    )
