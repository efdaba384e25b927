"""Registered queries: egress guard, leak check, log redaction, audits and masked predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.config import TRANSACTION_ENCRYPTED
from veilspark.functions import crypto
from veilspark.keyring import KeyRing
from veilspark.operators import egress, explain, masking, reports, scoring
from veilspark.operators.rows import one_row_each
from veilspark.plans import fixtures as fx
from veilspark.plans.registry import query, sql_iv, with_inputs
from veilspark.sources import schemas, sinks
from veilspark.sources.storage import shared_folder


def leaky(spark, sf_dir):
    """Masked transactions in which some sources forgot to mask a field."""
    plain = fx.transactions(spark, sf_dir)
    masked = masking.mask_transactions(
        plain.withColumns({"_email": F.col("email"), "_card": F.col("card_pan")}), fx.keyring(spark), fx.config()
    )
    leaky = masked.withColumns(
        {
            "email": F.when(F.col("channel") == "CH_BETA", F.col("_email")).otherwise(F.col("email")),
            "card_pan": F.when(F.col("merchant_country") == "BX", F.col("_card")).otherwise(F.col("card_pan")),
            "phone": F.when(F.col("channel") == "CH_GAMMA", F.lit(None)).otherwise(F.col("phone")),
        }
    )
    return schemas.with_schema_classes(leaky.drop("_email", "_card"), schemas.MASKED_TRANSACTION)


_EMAIL_OUT = "channel = 'ECOM'"
_CARD_OUT = "merchant_country = 'BX'"
_CLOUD_SQL = (
    "SELECT transaction_id, 'email' AS path, 'PII' AS classification, 'must be masked ciphertext' AS rule "
    f"FROM transactions WHERE {_EMAIL_OUT} UNION ALL "
    "SELECT transaction_id, 'card_pan', 'PCI', 'must be masked ciphertext' "
    f"FROM transactions WHERE {_CARD_OUT}"
)


@query(with_inputs(_CLOUD_SQL))
def egress_cloud_violations(spark, sf_dir):
    found = one_row_each(
        egress.report(leaky(spark, sf_dir), "cloud"), egress.VIOLATIONS, ("transaction_id",), "v"
    )
    return found.select("transaction_id", "v.*")


@query(with_inputs(f"SELECT path, classification, rule, count(*) AS violations FROM ({_CLOUD_SQL}) GROUP BY ALL"))
def egress_audit(spark, sf_dir):
    return reports.egress_audit(leaky(spark, sf_dir), "cloud")


@query(
    with_inputs(
        f"SELECT CASE WHEN {_EMAIL_OUT} OR {_CARD_OUT} THEN 'quarantined' ELSE 'passed' END AS outcome, "
        "count(*) AS n, count(DISTINCT transaction_id) AS ids FROM transactions GROUP BY 1"
    )
)
def egress_split(spark, sf_dir):
    """Each side reads the masked rows, which are stored first and so encrypted once."""
    path, rows = shared_folder(spark, "masked"), leaky(spark, sf_dir)
    rows.write.parquet(path)
    stored = schemas.with_schema_classes(spark.read.schema(rows.schema).parquet(path), schemas.MASKED_TRANSACTION)
    passed, quarantined = egress.guard(stored, "cloud", "split")
    sides = [
        side.select(F.lit(name).alias("outcome"), "transaction_id")
        for name, side in (("passed", passed), ("quarantined", quarantined))
    ]
    return sides[0].unionAll(sides[1]).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("transaction_id").alias("ids")
    )


@query(with_inputs("SELECT count(*) AS n, count(*) AS shaped, 0 AS opened FROM transactions"))
def egress_strict_check(spark, sf_dir):
    """A plain identifier of 24 characters has the shape of a ciphertext but does not open."""
    ring, config = fx.keyring(spark), fx.config()
    lookalike = F.concat(F.lit("identifier-"), F.substring("transaction_id", 1, 16)).alias(
        "customer_id", metadata={schemas.KEY: "PII"}
    )
    rows = fx.transactions(spark, sf_dir).select(lookalike).withColumn("_k", ring.keys("v1"))
    check = egress.authentic_with(F.col("_k"), F.lit("v1"), config.domain)
    shape = F.size(egress.violations(rows.drop("_k"), "cloud")) == 0
    strict = F.size(egress.violations(rows.drop("_k"), "cloud", authentic=check)) == 0
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(shape.cast("int")).alias("shaped"),
        F.sum(strict.cast("int")).alias("opened"),
    )


@query(with_inputs("SELECT count(*) AS n, count(DISTINCT customer_id) AS customers FROM transactions"))
def sink_guarded(spark, sf_dir):
    path = shared_folder(spark, "masked")
    masked = masking.mask_transactions(fx.transactions(spark, sf_dir), fx.keyring(spark), fx.config())
    sinks.write_guarded(sinks.masked_output(masked), path, "cloud")
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("customers")
    )


def _requests(spark, sf_dir):
    """Tokenized requests in which some sources put a plain value instead of a token."""
    rows = fx.transactions(spark, sf_dir).withColumn("customer", F.lit(None).cast(schemas.CUSTOMER))
    scored = scoring.attach_scores(rows, fx.score())
    prompted = explain.with_prompt(scored, fx.keyring(spark), fx.config())
    requested = prompted.withColumn("request", explain.masked_request())
    opened = F.when(F.col("channel") == "ATM", F.col("merchant_name"))
    listed = F.transform(
        "request.tokens",
        lambda t: F.when(
            (t["field"] == "merchant_name") & opened.isNotNull(), t.withField("token", opened)
        ).otherwise(t),
    )
    context = F.col("prompt.context").withField(
        "customer_phone_token",
        F.when(F.col("channel") == "MOB", F.col("phone")).otherwise(F.col("prompt.context.customer_phone_token")),
    )
    changed = requested.select(
        "transaction_id",
        F.struct("prompt.prompt_version", context.alias("context"), "prompt.reason_codes").cast(schemas.PROMPT).alias("prompt"),
        F.struct("request.prompt", listed.alias("tokens"), "request.reason_codes")
        .cast(schemas.MASKED_REQUEST).alias("request"),
    )
    return changed


@query(
    with_inputs(
        "SELECT transaction_id, 'request.tokens[4].token' AS path, 'PII' AS classification, 'must be ENC token' AS rule "
        "FROM transactions WHERE channel = 'ATM' UNION ALL "
        "SELECT transaction_id, 'prompt.context.customer_phone_token', 'PII', 'must be ENC token' "
        "FROM transactions WHERE channel = 'MOB'"
    )
)
def egress_nested_violations(spark, sf_dir):
    """Structs and lists of structs are checked field by field, with their paths."""
    found = one_row_each(
        egress.report(_requests(spark, sf_dir), "llm"), egress.VIOLATIONS, ("transaction_id",), "v"
    )
    return found.select("transaction_id", "v.*")


@query(
    with_inputs(
        "SELECT count(*) AS n, 16 AS guarded_columns, count(*) * 16 AS violations FROM transactions"
    )
)
def egress_llm_plain_records(spark, sf_dir):
    """Every guarded column of a plain record is a violation, numbers included."""
    found = egress.report(fx.transactions(spark, sf_dir).withColumn("note", F.lit(None).cast("string")), "llm")
    guarded = [c for c, k in schemas.classes_of(schemas.TRANSACTION).items() if k in egress.GUARDED["llm"]]
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(len(guarded)).alias("guarded_columns"),
        F.sum(F.size(egress.VIOLATIONS)).alias("violations"),
    )


_PROMPT_SQL = (
    "CASE channel WHEN 'POS' THEN concat('[[ENC|v1|x|AAAA]] pay ', printf('%.2f', amount), ' to ', lower(merchant_name)) "
    "WHEN 'ECOM' THEN concat('no token for ', upper(email)) WHEN 'ATM' THEN concat('[[ENC|v1|x|AAAA]] ', card_expiry, ' ', "
    "CAST(available_balance AS VARCHAR)) ELSE '[[ENC|v1|x|AAAA]] nothing else' END"
)
_LEAK_SQL = " UNION ALL ".join(
    ["SELECT transaction_id, 'prompt' AS field FROM p WHERE NOT contains(prompt, '[[ENC|')"]
    + [
        f"SELECT transaction_id, '{f}' FROM p WHERE length({f}) >= 5 AND contains(lower(prompt), lower({f}))"
        for f in egress.LEAK_TEXT_FIELDS
    ]
    + [
        f"SELECT transaction_id, '{f}' FROM p WHERE (length(CAST({f} AS VARCHAR)) >= 5 AND contains(prompt, CAST({f} AS VARCHAR))) "
        f"OR (length(printf('%.2f', {f})) >= 5 AND contains(prompt, printf('%.2f', {f})))"
        for f in egress.LEAK_NUMERIC_FIELDS
    ]
)


@query(with_inputs(f", p AS (SELECT *, {_PROMPT_SQL} AS prompt FROM transactions) {_LEAK_SQL}"))
def prompt_leaks(spark, sf_dir):
    rows = fx.transactions(spark, sf_dir)
    record = rows.select("*", F.struct(*rows.columns).alias("record"))
    pay = F.concat(
        F.lit("[[ENC|v1|x|AAAA]] pay "), F.format_string("%.2f", "amount"), F.lit(" to "), F.lower("merchant_name")
    )
    prompt = (
        F.when(F.col("channel") == "POS", pay)
        .when(F.col("channel") == "ECOM", F.concat(F.lit("no token for "), F.upper("email")))
        .when(
            F.col("channel") == "ATM",
            F.concat(F.lit("[[ENC|v1|x|AAAA]] "), "card_expiry", F.lit(" "), F.col("available_balance").cast("string")),
        )
        .otherwise(F.lit("[[ENC|v1|x|AAAA]] nothing else"))
    )
    leaks = record.withColumn("prompt", prompt).withColumn(
        "leaks", egress.leaked_fields(F.col("prompt"), F.col("record"))
    )
    return one_row_each(leaks, "leaks", ("transaction_id",), "field")


def _redacted(column: str) -> str:
    return f"concat('[redacted:', substr(sha256(concat('{fx.FIXTURE_SALT}', {column})), 1, 12), ']') AS {column}"


@query(with_inputs(f"SELECT * REPLACE ({', '.join(map(_redacted, TRANSACTION_ENCRYPTED))}) FROM transactions"))
def redact_for_log(spark, sf_dir):
    return egress.redact_for_log(fx.transactions(spark, sf_dir), fx.config().log_hash_salt)


@query(
    with_inputs(
        "SELECT transaction_id, merchant_name, "
        f"{_redacted('customer_id').replace(' AS customer_id', ' AS first_customer_id')}, "
        f"{_redacted('phone').replace(' AS phone', ' AS listed_phone')} FROM transactions"
    )
)
def redact_nested_for_log(spark, sf_dir):
    rows = fx.transactions(spark, sf_dir).select(
        "transaction_id",
        F.struct("customer_id", "merchant_name").alias("record"),
        F.array(F.struct("phone", "channel")).alias("contacts"),
    )
    classes = {
        "record.customer_id": "PII", "record.merchant_name": "CONFIDENTIAL",
        "contacts.phone": "PII", "contacts.channel": "INTERNAL",
    }
    hidden = egress.redact_for_log(rows, fx.config().log_hash_salt, classes)
    return hidden.select(
        "transaction_id",
        F.col("record.merchant_name").alias("merchant_name"),
        F.col("record.customer_id").alias("first_customer_id"),
        F.col("contacts")[0]["phone"].alias("listed_phone"),
    )


def _contained(spark, sf_dir):
    """Personal data in records inside maps and nested lists whose own class is INTERNAL."""
    phone = F.when(F.col("channel") == "ECOM", F.col("phone"))
    return fx.transactions(spark, sf_dir).select(
        "transaction_id",
        F.create_map(F.col("channel"), F.struct(phone.alias("phone"), "merchant_id")).alias("by_channel"),
        F.array(F.array(F.struct("email", "merchant_id"))).alias("nested"),
    )


_CONTAINED_CLASSES = {"by_channel.phone": "PII", "nested.email": "PII"}


@query(
    with_inputs(
        "SELECT transaction_id, 'by_channel.ECOM.phone' AS path FROM transactions WHERE channel = 'ECOM' "
        "UNION ALL SELECT transaction_id, 'nested[0][0].email' FROM transactions"
    )
)
def egress_map_violations(spark, sf_dir):
    rows = egress.report(_contained(spark, sf_dir), "cloud", classes=_CONTAINED_CLASSES)
    return one_row_each(rows, "violations", ("transaction_id",), "v").select("transaction_id", F.col("v.path").alias("path"))


@query(
    with_inputs(
        "SELECT transaction_id, merchant_id AS open_merchant, CASE WHEN channel = 'ECOM' THEN "
        f"{_redacted('phone').removesuffix(' AS phone')} END AS hidden_phone, "
        f"{_redacted('email').replace(' AS email', ' AS hidden_email')} FROM transactions"
    )
)
def redact_maps_and_lists_for_log(spark, sf_dir):
    hidden = egress.redact_for_log(_contained(spark, sf_dir), fx.config().log_hash_salt, _CONTAINED_CLASSES)
    value = F.map_values("by_channel")[0]
    return hidden.select(
        "transaction_id", value["merchant_id"].alias("open_merchant"), value["phone"].alias("hidden_phone"),
        F.col("nested")[0][0]["email"].alias("hidden_email"),
    )


@query(
    with_inputs("SELECT transaction_id, amount * 1.37::DOUBLE AS amount FROM transactions WHERE email = 'user.000007@example.com'")
)
def filter_masked_column(spark, sf_dir):
    """An equality predicate on plain text becomes a pushed-down literal on the masked table."""
    ring, config = fx.keyring(spark), fx.config()
    path = shared_folder(spark, "masked")
    masking.mask_transactions(fx.transactions(spark, sf_dir), ring, config).write.parquet(path)
    token = masking.masked_literal(ring, config, "email", "user.000007@example.com")
    return spark.read.parquet(path).where(F.col("email") == token).select("transaction_id", "amount")


def _frequencies(column: str) -> str:
    return with_inputs(
        f"SELECT frequency, count(*) AS plain_values, count(*) AS masked_values FROM "
        f"(SELECT count(*) AS frequency FROM transactions GROUP BY {column}) GROUP BY frequency"
    )


@query(_frequencies("mcc"))
def frequency_leakage_category(spark, sf_dir):
    plain = fx.transactions(spark, sf_dir)
    masked = masking.mask_transactions(plain, fx.keyring(spark), fx.config())
    return reports.frequency_leakage(plain, masked, "mcc")


@query(_frequencies("customer_id"))
def frequency_leakage_token(spark, sf_dir):
    plain = fx.transactions(spark, sf_dir)
    masked = masking.mask_transactions(plain, fx.keyring(spark), fx.config())
    return reports.frequency_leakage(plain, masked, "customer_id")


#: A keyed token is the same wherever it is made, so this also shows the version stamp is honoured.
@query(
    with_inputs(
        f"SELECT transaction_id, {sql_iv('phone', 'phone')} AS token_iv, phone FROM transactions"
    )
)
def open_by_version(spark, sf_dir):
    """Rows masked under two versions are opened with the key of their own version."""
    ring = KeyRing(spark, {"v1": fx.FIXTURE_KEY, "v2": fx.FIXTURE_KEY[::-1]})
    rows = fx.transactions(spark, sf_dir).select("transaction_id", "phone")
    old = masking.mask_transactions(rows, ring, fx.config())
    new = masking.mask_transactions(rows, ring, fx.config(mask_version="v2"))
    both = old.unionAll(new)
    plain = masking.unmask_transactions(both.withColumn("_token", F.col("phone")), ring, fx.config())
    iv = F.hex(F.substring(crypto.token_bytes(F.col("_token")), 1, 16))
    return (
        plain.groupBy("transaction_id", "phone")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_set(iv).alias("ivs"))
        .where(F.col("n") == 2)
        .join(_first_iv(old), "transaction_id")
        .where(F.array_contains("ivs", F.col("token_iv")))
        .select("transaction_id", "token_iv", "phone")
    )


def _first_iv(masked):
    iv = F.hex(F.substring(crypto.token_bytes(F.col("phone")), 1, 16))
    return masked.select("transaction_id", iv.alias("token_iv"))
