"""Registered queries: detection, anonymization and tokenized text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veilspark.functions import anonymizers, columns as C, recognizers as R, spans as sp, tokens
from veilspark.operators import explain, reports, scoring, text, validation
from veilspark.plans import entity_sql, fixtures as fx
from veilspark.plans.registry import query, with_inputs
from veilspark.sources.readers import text_with_replacements

DOC_ENTITIES = entity_sql.entities("documents", "doc_id")


def _documents(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


# --- detection ----------------------------------------------------------------------------------


@query(f'WITH {DOC_ENTITIES} SELECT k AS doc_id, entity_type, "start", "end", score, value AS text_preview FROM entities')
def detect_entities(spark, sf_dir):
    return text.entity_rows(text.analyze(_documents(spark, sf_dir)), "doc_id")


@query(
    "WITH " + entity_sql.entities("documents", "doc_id", [R.EMAIL])
    + ' SELECT k AS doc_id, "start", "end", value FROM entities'
)
def detect_email_spans(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = docs.select("doc_id", F.explode(sp.find_spans(F.col("text"), R.EMAIL.regex)).alias("s"))
    return found.select("doc_id", "s.*")


@query(
    "WITH " + entity_sql.entities("documents", "doc_id", threshold=0.5)
    + " SELECT entity_type, count(*) AS n, count(DISTINCT k) AS documents FROM entities GROUP BY 1"
)
def detect_above_threshold(spark, sf_dir):
    rows = text.entity_rows(text.analyze(_documents(spark, sf_dir), threshold=0.5), "doc_id")
    return rows.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents")
    )


@query(
    f"WITH {DOC_ENTITIES} SELECT doc_id, count(k) AS entity_count, coalesce(string_agg(DISTINCT entity_type, ',' "
    "ORDER BY entity_type), '') AS types FROM documents LEFT JOIN entities ON k = doc_id GROUP BY doc_id"
)
def entity_types_per_text(spark, sf_dir):
    found = text.analyze(_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        text.entity_count(F.col("entities")).alias("entity_count"),
        F.array_join(text.entity_types(F.col("entities")), ",").alias("types"),
    )


#: Sentences with house identifiers, with and without context words before them.
_CASES = """
SELECT transaction_id, concat(CASE mcc % 3 WHEN 0 THEN 'Open ticket no. ' WHEN 1 THEN 'See ' ELSE 'The case, as agreed upon by all of us, ' END,
  'CASE-', substr(transaction_ts, 1, 4), '-', lpad(CAST(mcc AS VARCHAR(4)), 4, '0'), ' of ',
  CASE WHEN mcc % 2 = 0 THEN 'client ' ELSE 'buyer ' END, customer_id, ' and cust-', substr(customer_id, 9),
  '; from ', ip_address, ' on ', substr(transaction_ts, 1, 10), ', ssn ', substr(card_pan, 13, 3), '-0', substr(phone, 3, 1), '-', substr(email, 8, 4),
  ', see https://example.com/', device_id, ' or IBAN DE',
  lpad(CAST(98 - CAST(concat(substr(card_pan, 1, 16), '13', CAST(10 + mcc % 89 AS VARCHAR(2)), '131400') AS DECIMAL(38, 0)) % 97 AS VARCHAR(4)), 2, '0'),
  substr(card_pan, 1, 16), '13', CAST(10 + mcc % 89 AS VARCHAR(2))) AS text
FROM {transactions}
"""


def _cases(spark, sf_dir):
    return spark.sql(_CASES, transactions=fx.transactions(spark, sf_dir))


def _with_cases(body: str) -> str:
    return with_inputs("").rstrip() + f", cases AS ({_CASES.format(transactions='transactions')}), {body}"


_HOUSE = (R.CUSTOMER_ID, R.CASE_ID)


@query(
    _with_cases(entity_sql.entities("cases", "transaction_id", _HOUSE))
    + ' SELECT k AS transaction_id, entity_type, "start", "end", score, value AS text_preview FROM entities'
)
def detect_house_identifiers(spark, sf_dir):
    """Scores rise where a context word is among the five tokens before the identifier."""
    found = text.analyze(_cases(spark, sf_dir), registry=_HOUSE)
    return text.entity_rows(found, "transaction_id")


@query(
    _with_cases(entity_sql.entities("cases", "transaction_id", _HOUSE, threshold=0.99))
    + " SELECT entity_type, count(*) AS n FROM entities GROUP BY 1"
)
def detect_needs_context(spark, sf_dir):
    """At 0.99 only identifiers with context remain."""
    found = text.analyze(_cases(spark, sf_dir), registry=_HOUSE, threshold=0.99)
    return text.entity_rows(found, "transaction_id").groupBy("entity_type").agg(F.count("*").alias("n"))


_OTHERS = (R.IPV4, R.IPV6, R.URL, R.IBAN, R.US_SSN, R.ISO_DATE, R.SLASH_DATE)


@query(
    _with_cases(entity_sql.entities("cases", "transaction_id", _OTHERS))
    + ' SELECT k AS transaction_id, entity_type, "start", "end", score, value AS text_preview FROM entities'
)
def detect_other_identifiers(spark, sf_dir):
    found = text.analyze(_cases(spark, sf_dir), registry=_OTHERS)
    return text.entity_rows(found, "transaction_id")


# --- names and places ---------------------------------------------------------------------------

_SCAN_SQL = (
    "concat('Customer ', {name}, ' initiated transaction ', t.transaction_id, '. Contact phone: ', {phone}, "
    "'. Email: ', {email}, '. Billing address: ', {address}, '. Card PAN: ', t.card_pan, '. Customer ID: ', "
    "t.customer_id, '. Merchant: ', t.merchant_name, '. Amount: ', printf('%.2f', t.amount), ' ', t.currency, '.')"
)
_OWN_SCAN = _SCAN_SQL.format(name="t.full_name", phone="t.phone", email="t.email", address="t.billing_address")
_SCANS = f"scans AS (SELECT transaction_id, {_OWN_SCAN} AS text, full_name, billing_address FROM transactions t)"


def _scans(spark, sf_dir):
    rows = fx.transactions(spark, sf_dir).withColumn(
        "customer", F.lit(None).cast("struct<full_name:string,phone:string,email:string,address:string>")
    )
    return rows.withColumn("text", explain.scan_text(rows))


def _names(spark, sf_dir):
    people = fx.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("phrase"), F.lit("PERSON").alias("entity_type")
    )
    places = fx.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("phrase"), F.lit("LOCATION").alias("entity_type")
    )
    return people.unionByName(places)


_PLACE = "substr(billing_address, 1, strpos(billing_address, ',') - 1)"


@query(
    with_inputs("").rstrip() + f", {_SCANS} "
    "SELECT transaction_id, 'PERSON' AS entity_type, CAST(strpos(text, full_name) - 1 AS INT) AS \"start\", "
    "CAST(strpos(text, full_name) - 1 + length(full_name) AS INT) AS \"end\", 0.85::DOUBLE AS score FROM scans "
    f"UNION ALL SELECT transaction_id, 'LOCATION', CAST(strpos(text, {_PLACE}) - 1 AS INT), "
    f"CAST(strpos(text, {_PLACE}) - 1 + length({_PLACE}) AS INT), 0.85::DOUBLE FROM scans"
)
def detect_names_and_places(spark, sf_dir):
    hits = text.dictionary_entities(_scans(spark, sf_dir), "transaction_id", "text", _names(spark, sf_dir))
    return hits.drop("text_preview")


@query(
    with_inputs("").rstrip() + f", {_SCANS} "
    f"SELECT transaction_id, replace(replace(text, full_name, '<PERSON>'), {_PLACE}, '<LOCATION>') AS anonymized_text FROM scans"
)
def anonymize_names_and_places(spark, sf_dir):
    """Dictionary hits joined back to their texts and replaced with the registry's."""
    scans = _scans(spark, sf_dir).select("transaction_id", "text")
    hits = text.dictionary_entities(scans, "transaction_id", "text", _names(spark, sf_dir))
    joined = scans.join(text.gather_spans(hits, "transaction_id"), "transaction_id", "left")
    done = text.anonymize(joined, registry=(), extra=[F.col("dictionary_spans")])
    return done.select("transaction_id", "anonymized_text")


@query(
    "WITH " + entity_sql.entities("documents", "doc_id", [R.EMAIL])
    + " SELECT k AS doc_id, 'completed' AS status, \"start\", \"end\", value AS text_preview FROM entities"
)
def detect_with_model(spark, sf_dir):
    """Any Python callable from text to spans stands in for a language model."""
    expression = R.EMAIL.pattern

    def load():
        pattern = re.compile(expression, re.IGNORECASE)
        return lambda value: [
            {"entity_type": "EMAIL_ADDRESS", "start": m.start(), "end": m.end(), "score": 0.9}
            for m in pattern.finditer(value)
        ]

    model = text.model_recognizer(load)
    found = _documents(spark, sf_dir).select("doc_id", model(F.col("text")).alias("m"))
    spans = found.select("doc_id", "m.status", F.explode("m.spans").alias("s"))
    return spans.select("doc_id", "status", "s.start", "s.end", "s.text_preview")


# --- anonymization ------------------------------------------------------------------------------


def _rewritten(replacement: str, column: str) -> str:
    return (
        f"WITH {DOC_ENTITIES}, {entity_sql.rewritten('documents', 'doc_id', replacement)} "
        f"SELECT r.k AS doc_id, r.text AS {column}, (SELECT count(*) FROM entities e WHERE e.k = r.k) AS entity_count "
        "FROM rewritten r"
    )


def _anonymized(spark, sf_dir, mode, column, **options):
    done = text.anonymize(_documents(spark, sf_dir), mode=mode, **options)
    return done.select("doc_id", column, F.size("entities").alias("entity_count"))


@query(_rewritten(entity_sql.REPLACE, "anonymized_text"))
def anonymize_replace(spark, sf_dir):
    return _anonymized(spark, sf_dir, "replace", "anonymized_text")


@query(_rewritten(entity_sql.MASK, "anonymized_text"))
def anonymize_mask(spark, sf_dir):
    return _anonymized(spark, sf_dir, "mask", "anonymized_text")


@query(_rewritten(entity_sql.REDACT, "redacted_text"))
def anonymize_redact(spark, sf_dir):
    return _anonymized(spark, sf_dir, "redact", "redacted_text")


@query(
    _rewritten(
        "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN concat('[redacted:', substr(sha256(concat('"
        + fx.FIXTURE_SALT + "', value)), 1, 12), ']') WHEN 'PHONE_NUMBER' THEN "
        "concat(substr(value, 1, length(value) - least(length(value), 4)), repeat('#', least(length(value), 4))) "
        "WHEN 'IP_ADDRESS' THEN '' ELSE '<PII>' END",
        "anonymized_text",
    )
)
def anonymize_custom_operators(spark, sf_dir):
    operators = {
        "EMAIL_ADDRESS": anonymizers.hash_with(fx.FIXTURE_SALT),
        "PHONE_NUMBER": anonymizers.mask_with("#", 4, from_end=True),
        "IP_ADDRESS": anonymizers.redact(),
        "CREDIT_CARD": anonymizers.replace_with("<PII>"),
    }
    return _anonymized(spark, sf_dir, "replace", "anonymized_text", operators=operators)


@query(
    _with_cases(
        entity_sql.entities("cases", "transaction_id") + ", "
        + entity_sql.rewritten("cases", "transaction_id", entity_sql.REPLACE)
    )
    + " SELECT k AS transaction_id, text AS anonymized_text FROM rewritten"
)
def anonymize_overlapping(spark, sf_dir):
    """Identifiers that overlap: each character some entity covers is replaced."""
    done = text.anonymize(_cases(spark, sf_dir))
    return done.select("transaction_id", "anonymized_text")


@query(
    f"WITH {DOC_ENTITIES} SELECT doc_id, 'Corpus scan' AS label, 'completed' AS status, count(k) AS entity_count, "
    "CAST(NULL AS VARCHAR) AS scanned_text FROM documents LEFT JOIN entities ON k = doc_id GROUP BY doc_id"
)
def scan_artifacts(spark, sf_dir):
    scanned = text.with_scan(_documents(spark, sf_dir), "scan", "text", "Corpus scan")
    s = F.col("scan")
    return scanned.select(
        "doc_id", s["label"].alias("label"), s["status"].alias("status"),
        s["entity_count"].alias("entity_count"), s["scanned_text"].alias("scanned_text"),
    )


# --- reports ------------------------------------------------------------------------------------


@query(
    f"WITH {DOC_ENTITIES} SELECT entity_type, lang, count(*) AS entities, count(DISTINCT k) AS documents "
    "FROM entities JOIN documents ON k = doc_id GROUP BY CUBE (entity_type, lang)"
)
def entity_profile_by_language(spark, sf_dir):
    return reports.entity_profile(text.analyze(_documents(spark, sf_dir)), "doc_id", "lang")


_DISCOVERY = (R.CUSTOMER_ID, R.EMAIL, R.INTERNATIONAL_PHONE, R.CREDIT_CARD, R.IPV4, R.ISO_DATE)
_DISCOVERED = (
    "customer_id", "full_name", "phone", "email", "card_pan", "card_expiry", "ip_address", "device_id",
    "merchant_name", "transaction_ts",
)


@query(
    with_inputs("").rstrip()
    + ", cells AS (UNPIVOT (SELECT transaction_id, "
    + ", ".join(_DISCOVERED)
    + " FROM transactions) ON "
    + ", ".join(_DISCOVERED)
    + " INTO NAME col VALUE text), keyed AS (SELECT concat(transaction_id, '/', col) AS id, col, text FROM cells), "
    + entity_sql.entities("keyed", "id", _DISCOVERY)
    + ' SELECT col AS "column", entity_type, count(DISTINCT k) AS n, any_value(total) AS "values", '
    "count(DISTINCT k) / any_value(total)::DOUBLE AS share FROM entities JOIN keyed ON k = id "
    "JOIN (SELECT col, count(*) AS total FROM keyed GROUP BY col) USING (col) GROUP BY col, entity_type"
)
def column_discovery(spark, sf_dir):
    return reports.column_discovery(fx.transactions(spark, sf_dir), _DISCOVERED, _DISCOVERY)


@query(
    "SELECT * FROM (VALUES ('customer_id', 'PII'), ('phone', 'PII'), ('email', 'PII'), ('card_pan', 'PCI'), "
    "('ip_address', 'PII')) v(\"column\", classification)"
)
def suggest_classes(spark, sf_dir):
    return reports.suggest_classes(column_discovery(spark, sf_dir))


_EVERY_TENTH = "substr(transaction_id, length(transaction_id), 1) = '7'"
_INSIDE = f"CASE WHEN {_EVERY_TENTH} THEN concat('x', upper(full_name), 'y ', text) ELSE replace(text, full_name, 'nobody') END"


@query(
    with_inputs(
        f", {_SCANS}, shown AS (SELECT transaction_id, lower({_INSIDE}) AS text FROM scans), "
        "sought AS (SELECT DISTINCT lower(full_name) AS value FROM customers WHERE length(full_name) >= 5) "
        "SELECT transaction_id, value FROM shown JOIN sought ON contains(text, value)",
        customers=True,
    )
)
def corpus_leaks(spark, sf_dir):
    """Customer names in scan texts: in a tenth of them inside a longer word and in capitals, elsewhere taken out."""
    scans = _scans(spark, sf_dir).withColumn("text", F.expr(_INSIDE))
    return reports.corpus_leaks(scans, "transaction_id", "text", fx.customers(spark, sf_dir), "full_name")


# --- tokens -------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price, printf('%.2f', o_totalprice) AS two_decimals, "
    "CAST(CAST(o_orderkey * 100000 AS DOUBLE) AS VARCHAR) AS whole, CAST(o_orderkey AS VARCHAR) AS key_text, "
    "printf('%.0f%%', o_orderkey % 1000 / 1000.0 * 100) AS percentage FROM orders"
)
def canonical_numbers(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    whole = (F.col("o_orderkey") * 100000).cast("double")
    return orders.select(
        "o_orderkey",
        C.canonical_text(F.col("o_totalprice"), "double").alias("price"),
        C.fixed_decimals(F.col("o_totalprice"), 2).alias("two_decimals"),
        C.canonical_text(whole, "double").alias("whole"),
        C.canonical_text(F.col("o_orderkey"), "bigint").alias("key_text"),
        C.percent(F.col("o_orderkey") % 1000 / 1000.0).alias("percentage"),
    )


_REPLACED = {
    "customer_name": "full_name", "customer_email": "email", "address": "billing_address",
    "card": "card_pan", "customer_id": "customer_id", "channel": "channel",
}
_SHOWN = r"(\[\[ENC\|v\d+\|[^|]+\|)[A-Za-z0-9_-]+=*\]\]"


def _hide_ciphers(column):
    """Tokens with a stand-in for the cipher, to compare with SQL."""
    return F.regexp_replace(column, _SHOWN, "$1*]]")


def _replacement_rows(spark, sf_dir):
    rows = _scans(spark, sf_dir).withColumn(
        "letter", F.concat(F.lit("Dear {{customer_name}}, "), F.col("text"), F.lit(" {{none}} "), F.col("full_name"))
    )
    return text_with_replacements(rows, "letter", _REPLACED).select("transaction_id", "text", "replacements")


def _replaced_sql() -> str:
    expression = "concat('Dear ', '[[ENC|v1|customer_name|*]]', ', ', text, ' {{none}} ', full_name)"
    for name, column in _REPLACED.items():
        if name != "customer_name":
            expression = f"replace({expression}, {column}, '[[ENC|v1|{name}|*]]')"
    return (
        with_inputs("").rstrip()
        + f", s AS (SELECT t.*, {_OWN_SCAN} AS text FROM transactions t) "
        + f"SELECT transaction_id, {expression} AS masked_text FROM s"
    )


@query(_replaced_sql())
def mask_text_values(spark, sf_dir):
    """Placeholders are replaced alone; values without one are replaced wherever they occur."""
    masked = explain.mask_texts(_replacement_rows(spark, sf_dir), fx.keyring(spark), fx.config())
    return masked.select("transaction_id", _hide_ciphers(F.col("masked_text")).alias("masked_text"))


@query(
    with_inputs("").rstrip()
    + f", {_SCANS} SELECT transaction_id, concat('Dear ', full_name, ', ', text, ' {{{{none}}}} ', full_name) AS text FROM scans"
)
def unmask_text_values(spark, sf_dir):
    ring, config = fx.keyring(spark), fx.config()
    masked = explain.mask_texts(_replacement_rows(spark, sf_dir), ring, config)
    return explain.unmask_texts(masked.select("transaction_id", "masked_text"), ring, config).select(
        "transaction_id", "text"
    )


@query(
    with_inputs(
        "SELECT CASE mcc % 5 WHEN 0 THEN 'text holds a reserved character' WHEN 1 THEN "
        "'a replacement key is empty or holds a reserved character' WHEN 2 THEN "
        "'a replacement value holds a reserved character' END AS problem, count(*) AS n, "
        "sum(CASE WHEN mcc % 5 > 2 THEN 1 ELSE 0 END)::BIGINT AS masked FROM transactions GROUP BY 1"
    )
)
def mask_text_problems(spark, sf_dir):
    """Rows that cannot be masked are reported; the others are masked."""
    kind, mark = F.col("mcc") % 5, F.lit("\ue000")
    rows = fx.transactions(spark, sf_dir).select(
        F.when(kind == 0, F.concat(F.col("email"), mark)).otherwise(F.col("email")).alias("text"),
        F.array(
            F.struct(
                F.when(kind == 1, "").otherwise(F.lit("email")).alias("key"),
                F.when(kind == 2, F.concat(F.col("email"), mark)).otherwise(F.col("email")).alias("value"),
            )
        ).alias("replacements"),
    )
    masked = explain.mask_texts(rows, fx.keyring(spark), fx.config(), on_error="null")
    tokenized = F.coalesce(F.col("masked_text").startswith("[[ENC|v1|email|"), F.lit(False))
    return masked.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum(tokenized.cast("bigint")).alias("masked"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'text_required' ELSE '' END AS violations FROM documents")
def validate_texts(spark, sf_dir):
    """A null text is rejected, an empty one is not."""
    kind = F.col("doc_id") % 5
    texts = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(kind == 1, "").when(kind != 0, F.coalesce("text", F.lit(""))).alias("text")
    )
    checked = validation.validate(texts, validation.text_rules())
    return checked.select("doc_id", F.array_join(validation.VIOLATIONS, ",").alias("violations"))


@query(
    with_inputs(
        "SELECT count(*) AS n, 0 AS opened, count(*) AS untokenized, 0 AS altered_opened, "
        "'Failed to decrypt token for field ''note''' AS altered_problem FROM transactions"
    )
)
def unmask_text_errors(spark, sf_dir):
    """Texts without a token and texts with a forged one are reported, not guessed."""
    ring, config = fx.keyring(spark), fx.config()
    rows = fx.transactions(spark, sf_dir).withColumn("_k", ring.keys("v1"))
    token = tokens.make_token("note", F.col("email"), "v1", F.col("_k"), config.domain)
    forged = F.replace(token, F.lit("[[ENC|v1|note|"), F.lit("[[ENC|v1|note|A"))
    plain = explain.unmask_texts(
        rows.select(F.col("full_name").alias("masked_text")), ring, config, on_error="null"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("text").alias("opened"),
        F.sum((F.col("problem") == "No ENC tokens found in text").cast("int")).alias("untokenized"),
    )
    altered = explain.unmask_texts(rows.select(forged.alias("masked_text")), ring, config, on_error="null")
    checked = altered.agg(
        F.count("text").alias("altered_opened"), F.max("problem").alias("altered_problem")
    )
    return plain.select("n", "opened", "untokenized", F.lit(1).alias("one")).join(
        checked.withColumn("one", F.lit(1)), "one"
    ).drop("one")


@query(
    with_inputs(
        "SELECT 'v1' AS version, field, count(*) AS n FROM transactions, "
        "(VALUES ('customer_name', 2), ('customer_email', 1), ('address', 1), ('card', 1), ('customer_id', 1)) f(field, times) "
        "GROUP BY ALL"
    )
)
def find_token_spans(spark, sf_dir):
    masked = explain.mask_texts(_replacement_rows(spark, sf_dir), fx.keyring(spark), fx.config())
    found = masked.select("transaction_id", F.explode(tokens.find_tokens(F.col("masked_text"))).alias("s"))
    parts = F.split("s.value", r"\|")
    return (
        found.groupBy(parts[1].alias("version"), parts[2].alias("field"))
        .agg(F.countDistinct("transaction_id").alias("n"))
    )


_CONTACT = {
    n: f"CASE WHEN c.email IS NOT NULL THEN c.{p} ELSE t.{o} END"
    for n, p, o in (
        ("name", "full_name", "full_name"), ("phone", "phone", "phone"),
        ("email", "email", "email"), ("address", "address", "billing_address"),
    )
}
_JOINED = "FROM transactions t LEFT JOIN profiles c USING (customer_id)"
_PERCENT = "printf('%.0f%%', (t.mcc % 101 / 100.0) * 100)"


@query(
    with_inputs(
        f"SELECT t.transaction_id, {_SCAN_SQL.format(**{n: f"coalesce({v}, '')" for n, v in _CONTACT.items()})} "
        f"AS scan_text {_JOINED}",
        profiles=True,
    )
)
def scan_texts(spark, sf_dir):
    joined = scoring.with_profile(fx.transactions(spark, sf_dir), fx.profiles(spark, sf_dir))
    return joined.select("transaction_id", explain.scan_text(joined).alias("scan_text"))


def _prompted(spark, sf_dir):
    joined = scoring.with_profile(fx.transactions(spark, sf_dir), fx.profiles(spark, sf_dir))
    scored = scoring.attach_scores(joined, fx.score())
    return explain.with_prompt(scored, fx.keyring(spark), fx.config())


CONTEXT_SQL = (
    f"SELECT t.transaction_id, {_CONTACT['name']} AS customer_name, coalesce({_CONTACT['phone']}, '') AS customer_phone, "
    f"{_CONTACT['email']} AS customer_email, printf('%.2f', t.amount) AS amount, t.merchant_name, t.transaction_ts, "
    f"{_PERCENT} AS fraud_probability {_JOINED}"
)


@query(with_inputs(CONTEXT_SQL, profiles=True))
def token_context(spark, sf_dir):
    """Each of the seven tokens opens to its expected text."""
    ring, config = fx.keyring(spark), fx.config()
    prompted = _prompted(spark, sf_dir).withColumn("_keys", ring.keys_by_version())
    names = list(explain.schemas.TOKEN_CLASSES)
    each = F.array(*[F.col(f"prompt.context.{n}_token") for n in names])
    opened = prompted.withColumn("_opened", tokens.open_texts(each, F.col("_keys"), config.domain))
    return opened.select(
        "transaction_id", *[F.get("_opened", F.lit(i))["plain"].alias(n) for i, n in enumerate(names)]
    )


def _token_sql(name: str) -> str:
    return f"'[[ENC|v1|{name}|*]]'"


_REASONS = "'DEVICE_NEW, AMOUNT_SPIKE, GEO_MISMATCH'"


@query(
    with_inputs(
        "SELECT transaction_id, concat('Provide RM explanation for customer ', "
        + _token_sql("customer_name") + ", ' regarding amount ', " + _token_sql("amount") + ", ' at ', "
        + _token_sql("merchant_name") + ", ' on ', " + _token_sql("transaction_ts") + ", '. Fraud score ', "
        + _token_sql("fraud_probability") + f", '. Reasons: ', {_REASONS}, '. Contact: ', "
        + _token_sql("customer_phone") + ", ', ', " + _token_sql("customer_email") + ", '.') AS prompt, "
        "'customer_name,customer_phone,customer_email,amount,merchant_name,transaction_ts,fraud_probability' AS fields, "
        "7 AS tokens, 3 AS reason_codes FROM transactions"
    )
)
def masked_request(spark, sf_dir):
    rows = _prompted(spark, sf_dir).withColumn("request", explain.masked_request())
    return rows.select(
        "transaction_id",
        _hide_ciphers(F.col("request.prompt")).alias("prompt"),
        F.array_join("request.tokens.field", ",").alias("fields"),
        F.size("request.tokens").alias("tokens"),
        F.size("request.reason_codes").alias("reason_codes"),
    )


@query(
    with_inputs(
        "SELECT transaction_id, concat('Transaction by ', "
        + _token_sql("customer_name") + ", ' for ', " + _token_sql("amount") + ", ' at ', "
        + _token_sql("merchant_name") + ", ' on ', " + _token_sql("transaction_ts") + ", ' received fraud score ', "
        + _token_sql("fraud_probability") + f", '. Reasons: ', {_REASONS}, '. Customer contact: ', "
        + _token_sql("customer_phone") + ", ', ', " + _token_sql("customer_email") + ", '.') AS explanation, "
        "concat('Call ', " + _token_sql("customer_name") + ", ' at ', " + _token_sql("customer_phone")
        + ", ' to confirm the transaction.') AS first_action, concat('If unreachable, send email to ', "
        + _token_sql("customer_email") + ", ' and place a temporary hold.') AS second_action, "
        "'Masked explanation generated for RM review only.' AS disclaimer FROM transactions"
    )
)
def masked_explanation(spark, sf_dir):
    rows = _prompted(spark, sf_dir).withColumn("r", explain.masked_explanation())
    return rows.select(
        "transaction_id",
        _hide_ciphers(F.col("r.rm_explanation_masked")).alias("explanation"),
        _hide_ciphers(F.col("r.recommended_actions_masked")[0]).alias("first_action"),
        _hide_ciphers(F.col("r.recommended_actions_masked")[1]).alias("second_action"),
        F.col("r.disclaimer_masked").alias("disclaimer"),
    )


EXPLAINED = (
    f"SELECT transaction_id, concat('Transaction by ', customer_name, ' for ', amount, ' at ', merchant_name, ' on ', "
    f"transaction_ts, ' received fraud score ', fraud_probability, '. Reasons: ', {_REASONS}, '. Customer contact: ', "
    "customer_phone, ', ', customer_email, '.') AS explanation, concat('Call ', customer_name, ' at ', customer_phone, "
    "' to confirm the transaction.') AS first_action, concat('If unreachable, send email to ', customer_email, "
    "' and place a temporary hold.') AS second_action"
)


@query(with_inputs(f"{EXPLAINED}, CAST(NULL AS VARCHAR) AS warning FROM ({CONTEXT_SQL})", profiles=True))
def unmask_explanation(spark, sf_dir):
    rows = _prompted(spark, sf_dir).withColumn("masked_result", explain.masked_explanation())
    opened = explain.unmask_explanation(rows, fx.keyring(spark), fx.config())
    r = F.col("unmasked_result")
    return opened.select(
        "transaction_id",
        r["rm_explanation"].alias("explanation"),
        r["recommended_actions"][0].alias("first_action"),
        r["recommended_actions"][1].alias("second_action"),
        F.col("unmask_warning").alias("warning"),
    )


@query(
    with_inputs("SELECT transaction_id, 'CREDIT_CARD' AS entity_type FROM transactions")
)
def entities_outside_tokens(spark, sf_dir):
    """The card stays in the text, the email is tokenized: only the card is found outside tokens."""
    ring, config = fx.keyring(spark), fx.config()
    rows = fx.transactions(spark, sf_dir).withColumn("_k", ring.keys("v1"))
    token = tokens.make_token("email", F.col("email"), "v1", F.col("_k"), config.domain)
    texts = rows.select(
        "transaction_id",
        F.concat(F.lit("Card "), "card_pan", F.lit(" and "), token, F.lit(".")).alias("text"),
    )
    registry = (R.CREDIT_CARD, R.Recognizer("CUSTOMER_ID", r"ENC\|v\d\|[a-z]+", 0.9))
    found = text.analyze(texts, registry=registry)
    left = sp.outside(F.col("entities"), tokens.find_tokens(F.col("text")))
    return text.entity_rows(found.withColumn("entities", left), "transaction_id").select(
        "transaction_id", "entity_type"
    )
