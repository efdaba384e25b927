"""Card transactions and customer profiles derived from the order tables.

The SQL runs unchanged on Spark and DuckDB; table names are its only parameters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.config import EngineConfig
from veilspark.keyring import KeyRing
from veilspark.sources import schemas

#: Key of the registered queries. Real keys come from the caller.
FIXTURE_KEY = hashlib.sha512(b"fixture key, not a secret").digest()
FIXTURE_SALT = "fixture-salt"

TRANSACTIONS_SQL = """
WITH k AS (
  SELECT o.*, c.c_name, c.c_acctbal, c.c_nationkey, c.c_mktsegment, n.n_name,
         lpad(CAST(c.c_custkey AS VARCHAR(20)), 6, '0') AS ck,
         concat(chr(65 + c.c_nationkey), 'X') AS cc
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
), g AS (
  SELECT k.*, CAST(substr(ck,1,1) AS INT) AS d5, CAST(substr(ck,2,1) AS INT) AS d4,
         CAST(substr(ck,3,1) AS INT) AS d3, CAST(substr(ck,4,1) AS INT) AS d2,
         CAST(substr(ck,5,1) AS INT) AS d1, CAST(substr(ck,6,1) AS INT) AS d0 FROM k
), l AS (
  SELECT g.*, (10 - (8 + 2*d0 - CASE WHEN d0 > 4 THEN 9 ELSE 0 END + d1
                       + 2*d2 - CASE WHEN d2 > 4 THEN 9 ELSE 0 END + d3
                       + 2*d4 - CASE WHEN d4 > 4 THEN 9 ELSE 0 END + d5) % 10) % 10 AS chk FROM g
)
SELECT concat('TXN-', lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0')) AS transaction_id,
  concat(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T00:00:00Z') AS transaction_ts,
  concat('CUST-', cc, '-', lpad(ck, 8, '0')) AS customer_id,
  c_name AS full_name,
  concat('+', CAST(10 + c_nationkey AS VARCHAR(4)), ' 5500 ', substr(ck, 3, 4)) AS phone,
  concat('user.', ck, '@example.com') AS email,
  concat(n_name, ', Street ', substr(ck, 4, 3), ', Building ', substr(ck, 5, 2)) AS billing_address,
  concat('400000000', ck, CAST(chk AS VARCHAR(2))) AS card_pan,
  concat(lpad(CAST(1 + o_custkey % 12 AS VARCHAR(2)), 2, '0'), '/', CAST(27 + o_custkey % 5 AS VARCHAR(2)))
    AS card_expiry,
  concat('203.0.113.', CAST(o_custkey % 256 AS VARCHAR(3))) AS ip_address,
  concat('DEV-', substr(md5(ck), 1, 8)) AS device_id,
  concat('MRC-', CAST(o_orderkey % 997 AS VARCHAR(4))) AS merchant_id,
  concat('MERCHANT ', CAST(o_orderkey % 997 AS VARCHAR(4))) AS merchant_name,
  CAST(o_orderkey % 10000 AS INT) AS mcc,
  cc AS merchant_country,
  concat('TERM-', CAST(o_orderkey % 4999 AS VARCHAR(5))) AS terminal_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'POS' WHEN 1 THEN 'ECOM' WHEN 2 THEN 'ATM' ELSE 'MOB' END AS channel,
  'USD' AS currency, o_totalprice AS amount, c_acctbal AS available_balance,
  CAST(1000 * (1 + o_custkey % 50) AS DOUBLE) AS credit_limit, (o_orderkey % 2 = 0) AS is_card_present{more}
FROM l
"""
CUSTOMERS_SQL = """
SELECT DISTINCT customer_id, full_name, phone, email, billing_address AS address,
  kyc_segment, 'EN' AS preferred_language FROM ({transactions}) t
"""
#: Profiles exist for some customers only, so that the optional lookup shows both outcomes.
PROFILES_SQL = """
SELECT customer_id, concat('Profile ', full_name) AS full_name,
  CASE WHEN kyc_segment = 'MACHINERY' THEN NULL ELSE phone END AS phone,
  concat('profile.', email) AS email, concat('Profile, ', address) AS address, kyc_segment, preferred_language
FROM ({customers}) c WHERE kyc_segment <> 'BUILDING'
"""

_NAMES = {"orders": "orders", "customer": "customer", "nation": "nation"}


def _sql(more: str = "", **tables: str) -> str:
    return TRANSACTIONS_SQL.format(**tables, more=more)


# The same inputs as SQL text for checking queries.
TRANSACTIONS = _sql(**_NAMES)
CUSTOMERS = CUSTOMERS_SQL.format(transactions=_sql(", c_mktsegment AS kyc_segment", **_NAMES))
PROFILES = PROFILES_SQL.format(customers=CUSTOMERS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt to tasks by a hash of ``keys``.

    A file is read by at most one task for each of its row groups, which may hold all its rows, and all narrow work behind the
    scan stays in that task. Rows are dealt while they are small, before they become texts and ciphers.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {name: table(spark, sf_dir, name) for name in _NAMES}
    return tables | {"orders": spread(tables["orders"], "o_orderkey", "o_custkey")}


def _marked(**names: str) -> dict[str, str]:
    return {n: "{" + n + "}" for n in _NAMES}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_sql(**_marked()), **_tables(spark, sf_dir))
    return schemas.with_schema_classes(df, schemas.TRANSACTION)


def _one_order_each(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables with one order of each customer. What is read of a customer's orders is that there are any, so keys are reduced
    where they are scanned, and texts are made once for each customer instead of each order."""
    tables = {name: table(spark, sf_dir, name) for name in _NAMES}
    return tables | {"orders": tables["orders"].dropDuplicates(["o_custkey"])}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = CUSTOMERS_SQL.format(transactions=_sql(", c_mktsegment AS kyc_segment", **_marked()))
    df = spark.sql(query, **_one_order_each(spark, sf_dir))
    return schemas.with_schema_classes(df, schemas.CUSTOMER)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = CUSTOMERS_SQL.format(transactions=_sql(", c_mktsegment AS kyc_segment", **_marked()))
    df = spark.sql(PROFILES_SQL.format(customers=base), **_one_order_each(spark, sf_dir))
    return schemas.with_schema_classes(df, schemas.CUSTOMER)


def config(**changes) -> EngineConfig:
    return EngineConfig(log_hash_salt=FIXTURE_SALT, allow_unmask=True, **changes)


def keyring(spark: SparkSession) -> KeyRing:
    return KeyRing(spark, {"v1": FIXTURE_KEY})


def score(mcc: str = "mcc"):
    """A score that depends on the record, over the whole range and on the band edges."""
    return F.col(mcc) % 101 / F.lit(100.0)
