"""Registered queries: sources, validation, masking, vault and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.config import CUSTOMER_ENCRYPTED, TRANSACTION_ENCRYPTED, MaskPolicy
from veilspark.functions import columns as C, crypto
from veilspark.keyring import KeyRing
from veilspark.operators import masking, scoring, validation, vault
from veilspark.operators.rows import one_row_each
from veilspark.plans import fixtures as fx
from veilspark.plans.registry import PERMUTATION, query, sql_iv, sql_network, sql_tracking_id, with_inputs
from veilspark.sources import readers, schemas, sinks
from veilspark.sources.storage import shared_folder

COLUMNS = ", ".join(schemas.TRANSACTION.fieldNames())


def stored_at():
    """Stands in for the ingest time, by day."""
    return F.to_timestamp(F.substring("transaction_ts", 1, 10))


def ingest_run():
    """Stands in for the ingest time of a few large runs, by year."""
    return F.date_trunc("year", stored_at())


# --- sources and validation ---------------------------------------------------------------------


@query(with_inputs(f"SELECT {COLUMNS}, 0 AS misfits FROM transactions"))
def source_transactions_json(spark, sf_dir):
    records = fx.transactions(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    parsed = readers.parse_json(records, "value", schemas.TRANSACTION)
    return parsed.withColumn("misfits", F.size(readers.TYPE_ERRORS)).drop(readers.TYPE_ERRORS)


@query(with_inputs("SELECT * FROM customers", customers=True))
def source_customers(spark, sf_dir):
    return readers.conform(fx.customers(spark, sf_dir), schemas.CUSTOMER).drop(readers.TYPE_ERRORS)


@query(
    "SELECT coalesce(lang, 'en') AS language, count(*) AS texts, sum(length(text)) AS characters "
    "FROM documents GROUP BY 1"
)
def source_text_language(spark, sf_dir):
    source = readers.text_source(fx.table(spark, sf_dir, "documents"), language_col="lang")
    return source.groupBy("language").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("characters")
    )


_RAW_PREDICTIONS = "CASE WHEN is_card_present THEN 'candidate-v3' END"


def predictions(spark, sf_dir):
    """Scores for every transaction, by tracking id; half of them name no model version."""
    tracked = vault.with_tracking_id(fx.transactions(spark, sf_dir), fx.keyring(spark), fx.config())
    return readers.prediction_source(
        tracked.select(
            "masked_id",
            fx.score().alias("fraud_probability"),
            F.when(F.col("is_card_present"), "candidate-v3").alias("model_version"),
        )
    )


PREDICTIONS = (
    f"SELECT {sql_tracking_id('transaction_id')} AS masked_id, mcc % 101 / 100.0::DOUBLE AS fraud_probability, "
    f"coalesce({_RAW_PREDICTIONS}, 'fraud-detector-v2.1') AS model_version, transaction_id AS id FROM transactions"
)


@query(with_inputs(f"SELECT masked_id, fraud_probability, model_version FROM ({PREDICTIONS})"))
def source_predictions(spark, sf_dir):
    return predictions(spark, sf_dir)


#: The transactions with faults in them: bad, missing and out-of-range values.
DIRTY = """
SELECT transaction_id,
  CASE WHEN mcc % 7 = 0 THEN 'bad' WHEN mcc % 11 = 0 THEN substr(transaction_ts, 1, 10)
       WHEN mcc % 13 = 0 THEN NULL WHEN mcc % 5 = 0 THEN concat(substr(transaction_ts, 1, 8), '32') ELSE transaction_ts END
    AS transaction_ts,
  customer_id, full_name, phone, CASE WHEN mcc % 37 = 0 THEN NULL ELSE email END AS email,
  billing_address, card_pan, card_expiry, ip_address, device_id, merchant_id, merchant_name,
  CASE WHEN mcc % 17 = 0 THEN mcc + 10000 WHEN mcc % 19 = 0 THEN -1 ELSE mcc END AS mcc,
  merchant_country, terminal_id, CASE WHEN mcc % 31 = 0 THEN 'WEB' ELSE channel END AS channel,
  CASE WHEN mcc % 23 = 0 THEN 'US' ELSE currency END AS currency,
  amount - 100000 AS amount, available_balance,
  CASE WHEN mcc % 29 = 0 THEN -credit_limit ELSE credit_limit END AS credit_limit, is_card_present
FROM {transactions}
"""


def _dirty(spark, sf_dir):
    return spark.sql(DIRTY, transactions=fx.transactions(spark, sf_dir))


_RULES_SQL = {
    "transaction_ts_required": "transaction_ts IS NULL",
    "email_required": "email IS NULL",
    "mcc_range": "mcc NOT BETWEEN 0 AND 9999",
    "currency_length": "length(currency) <> 3",
    "amount_not_negative": "amount < 0",
    "credit_limit_not_negative": "credit_limit < 0",
    "timestamp_parseable": "transaction_ts IS NOT NULL AND try_cast(transaction_ts AS TIMESTAMPTZ) IS NULL",
    "channel_known": "channel NOT IN ('POS', 'ECOM', 'ATM', 'MOB')",
}
_BROKEN = " UNION ALL ".join(
    f"SELECT transaction_id, '{rule}' AS rule FROM dirty WHERE {test}" for rule, test in _RULES_SQL.items()
)
_DIRTY_SQL = f"dirty AS ({DIRTY.format(transactions='transactions')})"


@query(
    with_inputs("").rstrip() + f", {_DIRTY_SQL}, broken AS ({_BROKEN}) "
    "SELECT rule, count(*) AS n FROM broken GROUP BY rule"
)
def validate_rules(spark, sf_dir):
    checked = validation.validate(_dirty(spark, sf_dir), validation.transaction_rules())
    return one_row_each(checked, "violations", (), "rule").groupBy("rule").agg(F.count("*").alias("n"))


@query(
    with_inputs("").rstrip() + f", {_DIRTY_SQL}, broken AS ({_BROKEN}) "
    "SELECT d.transaction_id, CASE WHEN b.transaction_id IS NULL THEN 'valid' ELSE 'rejected' END AS outcome FROM dirty d "
    "LEFT JOIN (SELECT DISTINCT transaction_id FROM broken) b USING (transaction_id)"
)
def sink_quarantine(spark, sf_dir):
    roots = {name: shared_folder(spark, name) for name in ("valid", "rejected")}
    checked = validation.validate(_dirty(spark, sf_dir), validation.transaction_rules())
    sinks.write_split(checked, roots["valid"], roots["rejected"])
    sides = [spark.read.parquet(p).select("transaction_id", F.lit(n).alias("outcome")) for n, p in roots.items()]
    return sides[0].unionAll(sides[1])


@query(
    with_inputs(
        f"SELECT count(*) AS n, sum(CASE WHEN s BETWEEN 0 AND 1 THEN 0 ELSE 1 END) AS rejected FROM "
        "(SELECT mcc % 150 / 100.0::DOUBLE AS s FROM transactions)"
    )
)
def validate_score_range(spark, sf_dir):
    scored = fx.transactions(spark, sf_dir).select(
        F.col("transaction_id").alias("masked_id"), (F.col("mcc") % 150 / 100.0).alias("fraud_probability")
    )
    checked = validation.validate(scored, validation.prediction_rules())
    return checked.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.size("violations") > 0, 1).otherwise(0)).alias("rejected"),
    )


# --- encryption ---------------------------------------------------------------------------------


def _masked(spark, sf_dir):
    return masking.mask_transactions(fx.transactions(spark, sf_dir), fx.keyring(spark), fx.config())


def _iv(column: str):
    raw = crypto.token_bytes(F.col(column))
    return F.hex(F.substring(raw, 1, 16)).alias(column)


@query(
    with_inputs(
        "SELECT transaction_id, "
        + ", ".join(f"{sql_iv(c, c)} AS {c}" for c in TRANSACTION_ENCRYPTED)
        + " FROM transactions"
    )
)
def encrypt_columns(spark, sf_dir):
    """The synthetic IV opens every token, so equal IVs show that MAC, key and field are right."""
    return _masked(spark, sf_dir).select("transaction_id", *[_iv(c) for c in TRANSACTION_ENCRYPTED])


@query(
    with_inputs(
        "SELECT "
        + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in TRANSACTION_ENCRYPTED)
        + " FROM transactions"
    )
)
def encrypt_keeps_distinctness(spark, sf_dir):
    return _masked(spark, sf_dir).agg(*[F.countDistinct(c).alias(c) for c in TRANSACTION_ENCRYPTED])


@query(
    with_inputs(
        "SELECT count(*) AS n, 0 AS altered, 0 AS other_field, 0 AS other_version, 0 AS other_key, "
        "count(*) AS intact FROM transactions"
    )
)
def decrypt_rejects_forgery(spark, sf_dir):
    config, ring = fx.config(), fx.keyring(spark)
    other = KeyRing(spark, {"v1": bytes(64)})
    rows = _masked(spark, sf_dir).select("email").withColumns(
        {"_k": ring.keys("v1"), "_o": other.keys("v1")}
    )
    token = F.col("email")
    # the 30th character, inside the first cipher block, is swapped for another one
    swapped = F.when(F.substring(token, 30, 1) == "A", "B").otherwise("A")
    altered = F.concat(F.substring(token, 1, 29), swapped, F.substr(token, F.lit(31), F.length(token)))

    def opens(value, field="email", version="v1", keys="_k"):
        plain = crypto.decrypt(value, F.lit(field), F.lit(version), F.col(keys), config.domain)
        return F.count(plain)

    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        opens(altered).alias("altered"),
        opens(token, field="phone").alias("other_field"),
        opens(token, version="v2").alias("other_version"),
        opens(token, keys="_o").alias("other_key"),
        opens(token).alias("intact"),
    )


@query(
    with_inputs(
        "SELECT count(DISTINCT customer_id) AS as_customer_id, count(DISTINCT customer_id) AS as_device_id, "
        "0 AS shared FROM transactions"
    )
)
def domain_separation(spark, sf_dir):
    config = fx.config()
    rows = fx.transactions(spark, sf_dir).withColumn("_k", fx.keyring(spark).keys("v1"))
    tokens = {
        name: crypto.encrypt(F.col("customer_id"), F.lit(name), F.lit("v1"), F.col("_k"), config.domain)
        for name in ("customer_id", "device_id")
    }
    pairs = rows.select(tokens["customer_id"].alias("a"), tokens["device_id"].alias("b"))
    return pairs.agg(
        F.countDistinct("a").alias("as_customer_id"),
        F.countDistinct("b").alias("as_device_id"),
        F.sum((F.col("a") == F.col("b")).cast("int")).alias("shared"),
    )


# --- numeric and categorical --------------------------------------------------------------------


@query(
    with_inputs(
        "SELECT transaction_id, amount * 1.37::DOUBLE AS amount, available_balance * 0.83::DOUBLE AS available_balance, "
        "credit_limit * 1.11::DOUBLE AS credit_limit FROM transactions"
    )
)
def scale_numeric(spark, sf_dir):
    return _masked(spark, sf_dir).select("transaction_id", "amount", "available_balance", "credit_limit")


@query(
    with_inputs(
        "SELECT transaction_id, round(amount, 2) AS amount, round(available_balance, 2) AS available_balance, "
        "round(credit_limit, 2) AS credit_limit FROM transactions"
    )
)
def unscale_numeric(spark, sf_dir):
    config = fx.config()
    scaled = scale_numeric(spark, sf_dir)
    return scaled.select(
        "transaction_id",
        *[C.unscale(F.col(n), s, round_to=2).alias(n) for n, s in config.scale_factors.items()],
    )


_PERMUTED = "FROM transactions t JOIN p ON t.mcc = p.value"


def _with_permutation(body: str) -> str:
    return with_inputs("").rstrip() + f", p AS ({PERMUTATION}) {body}"


@query(_with_permutation(f"SELECT transaction_id, CAST(masked AS INT) AS mcc {_PERMUTED}"))
def permute_category(spark, sf_dir):
    return _masked(spark, sf_dir).select("transaction_id", "mcc")


@query(_with_permutation(f"SELECT transaction_id, CAST(masked AS INT) AS mcc {_PERMUTED}"))
def permute_category_join(spark, sf_dir):
    rows = fx.transactions(spark, sf_dir).select("transaction_id", "mcc")
    return masking.permute_join(rows, "mcc", fx.keyring(spark), fx.config())


@query(with_inputs("SELECT transaction_id, mcc FROM transactions"))
def permute_category_inverse(spark, sf_dir):
    return masking.permute_join(
        permute_category(spark, sf_dir), "mcc", fx.keyring(spark), fx.config(), inverse=True
    )


LARGE_DOMAIN = 1_000_000_000


@query(sql_network("orders", "o_custkey", "o_orderkey", LARGE_DOMAIN))
def permute_large_domain(spark, sf_dir):
    """Order keys permuted within a thousand million numbers, without a table."""
    orders = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return masking.permute_number(orders, "o_orderkey", LARGE_DOMAIN, fx.keyring(spark), fx.config())


@query("SELECT o_custkey, o_orderkey FROM orders")
def permute_large_domain_inverse(spark, sf_dir):
    return masking.permute_number(permute_large_domain(spark, sf_dir), "o_orderkey", LARGE_DOMAIN, fx.keyring(spark), fx.config(), inverse=True)


@query("SELECT c_name AS value, c_name AS restored, true AS known FROM customer")
def permute_text_domain(spark, sf_dir):
    """Customer names permuted among themselves and back; every masked form is a name of the domain."""
    names = fx.table(spark, sf_dir, "customer").select("c_name")
    table = masking.value_permutation(names, "c_name", fx.keyring(spark), fx.config())
    back = table.select(F.col("masked").alias("_masked"), F.col("value").alias("restored"))
    masked = names.join(table, F.col("c_name") == F.col("value")).join(names.select(F.col("c_name").alias("name")).distinct(), F.col("masked") == F.col("name"), "left")
    joined = masked.join(back, F.col("masked") == F.col("_masked"))
    return joined.select("value", "restored", F.col("name").isNotNull().alias("known"))


_CHANNEL_SQL = (
    "CASE channel WHEN 'POS' THEN 'CH_ALPHA' WHEN 'ECOM' THEN 'CH_BETA' WHEN 'ATM' THEN 'CH_GAMMA' "
    "WHEN 'MOB' THEN 'CH_DELTA' ELSE channel END"
)


@query(with_inputs("").rstrip() + f", {_DIRTY_SQL} SELECT transaction_id, {_CHANNEL_SQL} AS channel FROM dirty")
def map_channel(spark, sf_dir):
    """Unknown channels pass through."""
    mapped = C.map_category(F.col("channel"), fx.config().channel_map)
    return _dirty(spark, sf_dir).select("transaction_id", mapped.alias("channel"))


@query(with_inputs("").rstrip() + f", {_DIRTY_SQL} SELECT transaction_id, channel FROM dirty")
def map_channel_inverse(spark, sf_dir):
    back = C.map_category(F.col("channel"), C.invert(fx.config().channel_map))
    return map_channel(spark, sf_dir).select("transaction_id", back.alias("channel"))


# --- whole records ------------------------------------------------------------------------------

_PLAIN = [c for c in schemas.TRANSACTION.fieldNames() if c not in MaskPolicy.transactions(fx.config()).columns]


@query(
    _with_permutation(
        f"SELECT {', '.join(_PLAIN)}, CAST(masked AS INT) AS mcc, {_CHANNEL_SQL} AS channel, "
        "amount * 1.37::DOUBLE AS amount, available_balance * 0.83::DOUBLE AS available_balance, "
        f"credit_limit * 1.11::DOUBLE AS credit_limit, 'v1' AS mask_version, 9 AS ciphertexts {_PERMUTED}"
    )
)
def mask_transactions(spark, sf_dir):
    ciphertexts = sum(
        (F.when(crypto.is_ciphertext(F.col(c)), 1).otherwise(0) for c in TRANSACTION_ENCRYPTED), F.lit(0)
    )
    masked = sinks.masked_output(_masked(spark, sf_dir)).withColumn("ciphertexts", ciphertexts)
    return masked.drop(*TRANSACTION_ENCRYPTED)


@query(
    with_inputs(
        f"SELECT * REPLACE (round(amount, 2) AS amount, round(available_balance, 2) AS available_balance) "
        "FROM transactions"
    )
)
def unmask_transactions(spark, sf_dir):
    return masking.unmask_transactions(
        _masked(spark, sf_dir), fx.keyring(spark), fx.config(), round_to=2
    )


_CUSTOMER_LEVEL = list(TRANSACTION_ENCRYPTED)


@query(
    with_inputs(
        f"SELECT transaction_id, mcc, {_CHANNEL_SQL} AS channel, amount * 1.37::DOUBLE AS amount, "
        f"credit_limit * 4::DOUBLE AS credit_limit, {sql_iv('email', 'email')} AS email FROM transactions"
    )
)
def mask_by_policy_table(spark, sf_dir):
    """The policy is a table; a column it does not name stays, and a name the table lacks is ignored."""
    config, rows = fx.config(), fx.transactions(spark, sf_dir)
    named = spark.createDataFrame(
        [("email", "encrypt", None), ("amount", "scale", None), ("credit_limit", "scale", 4.0), ("channel", "map", None),
         ("absent", "encrypt", None)],
        "column string, strategy string, factor double",
    )
    masked = masking.mask(rows, MaskPolicy.from_table(named, rows, config), fx.keyring(spark), config)
    return masked.select("transaction_id", "mcc", "channel", "amount", "credit_limit", _iv("email"))


@query(
    with_inputs(
        "SELECT transaction_id, mcc % 2 AS parity, amount * 1.37::DOUBLE AS amount, "
        + ", ".join(f"{sql_iv(c, c)} AS {c}" for c in TRANSACTION_ENCRYPTED)
        + " FROM transactions"
    )
)
def mask_transactions_by_dictionary(spark, sf_dir):
    """Customer columns repeat across transactions: each combination is encrypted once."""
    config = fx.config()
    masked = masking.mask_repeated(
        fx.transactions(spark, sf_dir).withColumn("parity", F.col("mcc") % 2), _CUSTOMER_LEVEL,
        MaskPolicy.transactions(config), fx.keyring(spark), config,
    )
    return masked.select("transaction_id", "parity", "amount", *[_iv(c) for c in _CUSTOMER_LEVEL])


@query(
    with_inputs(
        "SELECT * REPLACE (round(amount, 2) AS amount, round(available_balance, 2) AS available_balance) "
        "FROM transactions"
    )
)
def unmask_transactions_by_dictionary(spark, sf_dir):
    config, ring = fx.config(), fx.keyring(spark)
    policy = MaskPolicy.transactions(config)
    path = shared_folder(spark, "masked")
    _masked(spark, sf_dir).write.parquet(path)
    masked = spark.read.parquet(path)
    return masking.unmask_repeated(masked, _CUSTOMER_LEVEL, policy, ring, config, round_to=2)


@query(
    with_inputs(
        "SELECT "
        + ", ".join(f"{sql_iv(c, c)} AS {c}" for c in CUSTOMER_ENCRYPTED)
        + ", kyc_segment, preferred_language, 'v1' AS mask_version FROM customers",
        customers=True,
    )
)
def mask_customers(spark, sf_dir):
    masked = masking.mask_customers(fx.customers(spark, sf_dir), fx.keyring(spark), fx.config())
    output = sinks.masked_output(masked, customers=True)
    return output.withColumns({c: _iv(c) for c in CUSTOMER_ENCRYPTED})


@query(with_inputs("SELECT * FROM customers", customers=True))
def unmask_customers(spark, sf_dir):
    ring, config = fx.keyring(spark), fx.config()
    masked = masking.mask_customers(fx.customers(spark, sf_dir), ring, config)
    return masking.unmask_customers(masked, ring, config)


@query(
    with_inputs(
        "SELECT c.kyc_segment, count(*) AS n, count(DISTINCT t.customer_id) AS customers FROM transactions t "
        "JOIN customers c ON t.customer_id = c.customer_id AND t.full_name = c.full_name "
        "AND t.phone = c.phone AND t.email = c.email GROUP BY 1",
        customers=True,
    )
)
def join_masked_tables(spark, sf_dir):
    """Masked tables join on masked keys as the plain ones do."""
    config, ring = fx.config(), fx.keyring(spark)
    keys = ["customer_id", "full_name", "phone", "email"]
    masked = _masked(spark, sf_dir).select(*keys)
    profiles = masking.mask_customers(fx.customers(spark, sf_dir), ring, config)
    joined = masked.join(profiles.select(*keys, "kyc_segment"), keys)
    return joined.groupBy("kyc_segment").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("customers")
    )


# --- vault --------------------------------------------------------------------------------------


@query(with_inputs(f"SELECT transaction_id, {sql_tracking_id('transaction_id')} AS masked_id FROM transactions"))
def tracking_ids(spark, sf_dir):
    tracked = vault.with_tracking_id(fx.transactions(spark, sf_dir), fx.keyring(spark), fx.config())
    return tracked.select("transaction_id", "masked_id")


@query(
    _with_permutation(
        f"SELECT {sql_tracking_id('transaction_id', 'run1')} AS masked_id, CAST(masked AS INT) AS mcc, "
        f"{_CHANNEL_SQL} AS channel, currency, amount * 1.37::DOUBLE AS amount, "
        "available_balance * 0.83::DOUBLE AS available_balance, credit_limit * 1.11::DOUBLE AS credit_limit, "
        f"is_card_present, merchant_country {_PERMUTED}"
    )
)
def track_and_project_features(spark, sf_dir):
    """Vault written first, cloud features read back from it."""
    masked = vault.mask_and_track(
        fx.transactions(spark, sf_dir), shared_folder(spark, "vault"), "run1",
        fx.keyring(spark), fx.config(), ingest_run(),
    )
    return sinks.cloud_features(masked)


def vault_rows(spark, sf_dir, at=stored_at):
    return vault.vault_rows(fx.transactions(spark, sf_dir), fx.keyring(spark), fx.config(), at())


@query(
    with_inputs(
        "SELECT count(*) AS n, count(DISTINCT transaction_id) AS ids, count(DISTINCT substr(transaction_ts, 1, 4)) "
        "AS dates FROM transactions"
    )
)
def sink_vault(spark, sf_dir):
    """A repeated run replaces its own rows. They are stored first, so that both writes hold ciphers made once."""
    path, made = shared_folder(spark, "vault"), shared_folder(spark, "vault-rows")
    masked = vault_rows(spark, sf_dir, ingest_run)
    masked.write.parquet(made)
    rows = spark.read.schema(masked.schema).parquet(made)
    vault.write_vault(rows, path, "run1")
    vault.write_vault(rows, path, "run1")
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("masked_id").alias("ids"),
        F.countDistinct("ingest_date").alias("dates"),
    )


_LIVE = "CAST(substr(transaction_ts, 1, 10) AS TIMESTAMP) >= TIMESTAMP '1997-01-01 12:00:00' - INTERVAL 8760 HOURS"


def _live_vault(spark, sf_dir):
    return vault.live(vault_rows(spark, sf_dir), F.lit("1997-01-01 12:00:00"), 8760)


@query(
    with_inputs(
        f"SELECT {sql_tracking_id('transaction_id')} AS masked_id, transaction_id, amount FROM transactions WHERE {_LIVE}"
    )
)
def vault_time_to_live(spark, sf_dir):
    return _live_vault(spark, sf_dir).select("masked_id", "original.transaction_id", "original.amount")


@query(with_inputs("SELECT * FROM transactions WHERE transaction_id = 'TXN-000000000007'"))
def vault_point_lookup(spark, sf_dir):
    ring, config = fx.keyring(spark), fx.config()
    wanted = spark.createDataFrame([("TXN-000000000007",)], "transaction_id string")
    masked_id = vault.with_tracking_id(wanted, ring, config).first()["masked_id"]
    return vault.original_of(vault_rows(spark, sf_dir), masked_id)


@query(
    with_inputs(
        f"SELECT {sql_tracking_id('transaction_id', 'run1', 32)} AS masked_id, transaction_id, "
        f"'p' || substr({sql_tracking_id('transaction_id', 'run1', 32)}, 6, 1) AS id_prefix FROM transactions"
    )
)
def vault_by_prefix(spark, sf_dir):
    """Ids of 128 bits, in one folder for each first digit."""
    ring, config = fx.keyring(spark), fx.config(tracking_id_bytes=16)
    path = shared_folder(spark, "vault")
    rows = vault.vault_rows(fx.transactions(spark, sf_dir), ring, config, ingest_run(), "run1")
    vault.write_vault(rows, path, "run1", prefix_digits=1, refuse_collisions=True)
    return vault.read_vault(spark, path).select("masked_id", "original.transaction_id", "id_prefix")


RECOMMENDATION_SQL = (
    "CASE WHEN fraud_probability < 0.3 THEN 'APPROVE - Low risk transaction' "
    "WHEN fraud_probability < 0.7 THEN 'REVIEW - Medium risk, manual review recommended' "
    "ELSE 'DECLINE - High risk, potential fraud' END"
)


@query(
    with_inputs(
        "SELECT masked_id, fraud_probability, model_version, customer_id, full_name, phone, email, "
        "right(card_pan, 4) AS card_pan_last4, transaction_id, amount AS amount_original, "
        f"{RECOMMENDATION_SQL} AS recommendation FROM ({PREDICTIONS}) p JOIN transactions t "
        f"ON p.id = t.transaction_id WHERE {_LIVE}"
    )
)
def restore_identity(spark, sf_dir):
    return vault.restore_identity(predictions(spark, sf_dir), _live_vault(spark, sf_dir))


@query(
    with_inputs(
        f"SELECT masked_id, fraud_probability, model_version FROM ({PREDICTIONS}) p JOIN transactions t "
        f"ON p.id = t.transaction_id WHERE NOT ({_LIVE})"
    )
)
def unmatched_predictions(spark, sf_dir):
    return vault.unmatched(predictions(spark, sf_dir), _live_vault(spark, sf_dir))


# --- scoring ------------------------------------------------------------------------------------

_JOINED = "FROM transactions t LEFT JOIN profiles c USING (customer_id)"


@query(
    with_inputs(
        "SELECT transaction_id, "
        "CASE WHEN c.email IS NOT NULL THEN c.full_name ELSE t.full_name END AS full_name, "
        "CASE WHEN c.email IS NOT NULL THEN c.phone ELSE t.phone END AS phone, "
        "CASE WHEN c.email IS NOT NULL THEN c.email ELSE t.email END AS email, "
        f"CASE WHEN c.email IS NOT NULL THEN c.address ELSE t.billing_address END AS address {_JOINED}",
        profiles=True,
    )
)
def customer_profile_lookup(spark, sf_dir):
    joined = scoring.with_profile(fx.transactions(spark, sf_dir), fx.profiles(spark, sf_dir))
    return joined.select("transaction_id", *[c.alias(n) for n, c in scoring.contact(joined).items()])


@query(
    with_inputs(
        f"SELECT {RECOMMENDATION_SQL} AS recommendation, CASE WHEN fraud_probability >= 0.7 THEN 'HIGH' "
        "WHEN fraud_probability >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, count(*) AS n, "
        f"min(fraud_probability) AS lowest FROM ({PREDICTIONS}) GROUP BY 1, 2"
    )
)
def risk_bands(spark, sf_dir):
    p = F.col("fraud_probability")
    return (
        predictions(spark, sf_dir)
        .groupBy(C.recommendation(p).alias("recommendation"), C.risk_level(p).alias("risk_level"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("lowest"))
    )


@query(
    with_inputs(
        "SELECT t.transaction_id, p.fraud_probability, 'DEVICE_NEW, AMOUNT_SPIKE, GEO_MISMATCH' AS reasons, "
        f"0.75::DOUBLE AS constant_score FROM transactions t JOIN ({PREDICTIONS}) p ON p.id = t.transaction_id"
    )
)
def attach_scores(spark, sf_dir):
    """Scores joined from a predictions table, and the constant."""
    tracked = vault.with_tracking_id(fx.transactions(spark, sf_dir), fx.keyring(spark), fx.config())
    scored = scoring.attach_scores(tracked, predictions(spark, sf_dir))
    constant = scoring.attach_scores(
        scored.withColumnRenamed("fraud_probability", "joined"), None
    )
    return constant.select(
        "transaction_id",
        F.col("joined").alias("fraud_probability"),
        F.array_join("reason_codes", ", ").alias("reasons"),
        F.col("fraud_probability").alias("constant_score"),
    )


@query(
    with_inputs(
        f"SELECT t.*, {sql_iv('t.customer_id', 'customer_id')} AS token_iv, p.fraud_probability, "
        "CASE WHEN p.fraud_probability >= 0.7 THEN 'HIGH' WHEN p.fraud_probability >= 0.3 THEN 'MEDIUM' "
        "ELSE 'LOW' END AS risk_level, 'DEVICE_NEW' AS first_reason, '2026-01-20T10:15:30.000000Z' AS scoring_timestamp "
        f"FROM transactions t JOIN ({PREDICTIONS}) p ON p.id = t.transaction_id"
    )
)
def decision_record(spark, sf_dir):
    ring, config = fx.keyring(spark), fx.config()
    scored = scoring.attach_scores(fx.transactions(spark, sf_dir), fx.score())
    token = crypto.encrypt(
        F.col("customer_id"), F.lit("customer_id"), F.lit("v1"), F.col("_k"), config.domain
    )
    decided = scoring.decision_record(
        scored.withColumn("_k", ring.keys("v1")), token, F.lit("2026-01-20 10:15:30")
    )
    s = F.col("_fraud_scoring")
    iv = F.hex(F.substring(crypto.token_bytes(s["token_customer_id"]), 1, 16))
    return decided.select(
        *schemas.TRANSACTION.fieldNames(),
        iv.alias("token_iv"),
        s["fraud_probability"].alias("fraud_probability"),
        s["risk_level"].alias("risk_level"),
        s["reason_codes"][0].alias("first_reason"),
        s["scoring_timestamp"].alias("scoring_timestamp"),
    )


@query(with_inputs("SELECT count(*) AS n, count(*) AS ids FROM transactions"))
def vault_replay_next_day(spark, sf_dir):
    """A run repeated after midnight replaces its rows of the day before."""
    path, config = shared_folder(spark, "vault"), fx.config()
    rows, ring = fx.transactions(spark, sf_dir), fx.keyring(spark)
    for day in ("2026-01-20 23:59:00", "2026-01-21 00:01:00"):
        tracked = vault.mask_and_track(rows, path, "run1", ring, config, F.lit(day))
    return tracked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("masked_id").alias("ids"))


@query(
    with_inputs(
        "SELECT transaction_id AS masked_id, count(DISTINCT customer_id) AS records FROM "
        "(SELECT left(transaction_id, 15) AS transaction_id, transaction_id AS customer_id FROM transactions) "
        "GROUP BY 1 HAVING count(DISTINCT customer_id) > 1"
    )
)
def tracking_id_collisions(spark, sf_dir):
    """Ids cut to fifteen characters, which collide."""
    rows = fx.transactions(spark, sf_dir)
    cut = rows.select(F.left("transaction_id", F.lit(15)).alias("masked_id"), F.struct("transaction_id").alias("original"))
    return vault.tracking_id_collisions(cut)
