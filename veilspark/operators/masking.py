"""Policy-driven masking and unmasking of tables and streams.

Masking is one projection: the key and the permutation arrive as scalar subqueries, so there is no
join and no shuffle, and Catalyst prunes the ciphers of columns that are not selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.config import EngineConfig, MaskPolicy
from veilspark.functions import columns as C, crypto, permutation
from veilspark.keyring import KeyRing
from veilspark.operators.lookup import via_dictionary
from veilspark.sources import schemas
from veilspark.sources.storage import shared_folder

VERSION = "mask_version"


def _keep_class(df: DataFrame, name: str, value: Column) -> Column:
    return value.alias(name, metadata=df.schema[name].metadata)


def mask(df: DataFrame, policy: MaskPolicy, keyring: KeyRing, config: EngineConfig) -> DataFrame:
    """Mask the policy's columns and stamp ``mask_version``. Columns a table lacks are skipped."""
    version = config.mask_version
    keyed = df.withColumn("_keys", keyring.keys(version))
    if any(s.kind == "permute" and n in df.columns for n, s in policy.columns.items()):
        table = keyring.permutation(version, config.category_domain)
        keyed = keyed.withColumn("_order", table.select("forward").scalar())
    out = []
    for name in df.columns:
        value, strategy = F.col(name), policy.columns.get(name)
        if strategy is None:
            out.append(value)
            continue
        if strategy.kind == "encrypt":
            masked = crypto.encrypt(
                value, F.lit(name), F.lit(version), F.col("_keys"), config.domain
            )
        elif strategy.kind == "scale":
            masked = C.scale(value, strategy.factor)
        elif strategy.kind == "map":
            masked = C.map_category(value, dict(strategy.mapping))
        else:
            masked = _in_domain(value, C.permute(value, F.col("_order")), name)
        out.append(_keep_class(df, name, masked))
    stamp = F.lit(version).alias(VERSION, metadata={schemas.KEY: "INTERNAL"})
    return keyed.select(*out, stamp)


def mask_repeated(
    df: DataFrame, columns: list[str], policy: MaskPolicy, keyring: KeyRing, config: EngineConfig,
    split_hot: bool = True,
) -> DataFrame:
    """As :func:`mask`, but encrypt ``columns`` once per distinct combination of their values.

    Setting up a cipher costs far more than moving a row, so this is faster where the combinations
    repeat several times. It needs a join and works on tables only.
    """
    encrypted = {n: policy.columns[n] for n in columns}
    if any(s.kind != "encrypt" for s in encrypted.values()):
        raise ValueError("only encrypted columns go through a dictionary")
    rest = MaskPolicy({n: s for n, s in policy.columns.items() if n not in encrypted})
    masked = via_dictionary(
        df, list(columns), lambda d: mask(d, MaskPolicy(encrypted), keyring, config).drop(VERSION), split_hot
    )
    out = mask(masked, rest, keyring, config)
    return schemas.with_classes(out, schemas.declared_classes(df.schema))


def unmask_repeated(
    df: DataFrame, columns: list[str], policy: MaskPolicy, keyring: KeyRing, config: EngineConfig,
    split_hot: bool = True, **options,
) -> DataFrame:
    """As :func:`unmask`, but decrypt ``columns`` once per distinct combination of their tokens."""
    config.require_unmask()
    encrypted = {n: policy.columns[n] for n in columns}
    rest = MaskPolicy({n: s for n, s in policy.columns.items() if n not in encrypted})

    def opened(distinct: DataFrame) -> DataFrame:
        stamped = distinct.withColumn("_stamp", F.col(VERSION))
        plain = unmask(stamped, MaskPolicy(encrypted), keyring, config, **options)
        return plain.withColumnRenamed("_stamp", VERSION)

    joined = via_dictionary(df, [*columns, VERSION], opened, split_hot)
    out = unmask(joined, rest, keyring, config, **options)
    return schemas.with_classes(out, schemas.declared_classes(df.drop(VERSION).schema))


def _in_domain(value: Column, looked_up: Column, name: str) -> Column:
    """Null stays null; a value outside the permutation's domain fails the job."""
    message = F.concat(F.lit(f"{name} is outside the permutation's domain: "), value.cast("string"))
    return crypto.fail_unless(value.isNull() | looked_up.isNotNull(), looked_up, message)


def unmask(
    df: DataFrame,
    policy: MaskPolicy,
    keyring: KeyRing,
    config: EngineConfig,
    on_error: str = "fail",
    round_to: int | None = None,
) -> DataFrame:
    """Reverse :func:`mask` and drop ``mask_version``; each row uses the key of its own version.

    A token that was altered, or made for another field, version or key, fails the job, or becomes
    null with ``on_error="null"``.
    """
    config.require_unmask()
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    keyed = df.withColumn("_keys", F.try_element_at(keyring.keys_by_version(), F.col(VERSION)))
    encrypted = [n for n in df.columns if getattr(policy.columns.get(n), "kind", "") == "encrypt"]
    if encrypted:
        sealed = [
            F.struct(crypto.token_bytes(F.col(n)).alias("raw"), F.lit(n).alias("field"), F.col(VERSION).alias("version"))
            for n in encrypted
        ]
        keyed = keyed.withColumn("_plain", crypto.decrypt_all(F.array(*sealed), F.col("_keys"), config.domain))
    orders = _inverse_orders(df, policy, keyring, config)
    if orders is not None:
        keyed = keyed.withColumn("_order", F.try_element_at(orders, F.col(VERSION)))
    out = []
    for name in df.columns:
        value, strategy = F.col(name), policy.columns.get(name)
        if name == VERSION:
            continue
        if strategy is None:
            out.append(value)
            continue
        if strategy.kind == "encrypt":
            plain = F.get("_plain", F.lit(encrypted.index(name)))
            if on_error == "fail":
                message = F.lit(f"cannot decrypt {name}")
                plain = crypto.fail_unless(value.isNull() | plain.isNotNull(), plain, message)
        elif strategy.kind == "scale":
            plain = C.unscale(value, strategy.factor, round_to)
        elif strategy.kind == "map":
            plain = C.map_category(value, C.invert(dict(strategy.mapping)))
        else:
            plain = C.permute(value, F.col("_order"))
            if on_error == "fail":
                plain = _in_domain(value, plain, name)
        out.append(_keep_class(df, name, plain))
    return keyed.select(*out)


def _inverse_orders(
    df: DataFrame, policy: MaskPolicy, keyring: KeyRing, config: EngineConfig
) -> Column | None:
    """``map<version, inverse permutation>`` if a column needs it."""
    if not any(s.kind == "permute" and n in df.columns for n, s in policy.columns.items()):
        return None
    tables = [
        keyring.permutation(v, config.category_domain).select(F.lit(v).alias("v"), "inverse")
        for v in keyring.versions
    ]
    every = tables[0]
    for table in tables[1:]:
        every = every.unionAll(table)
    entries = F.collect_list(F.struct("v", "inverse"))
    return every.agg(F.map_from_entries(entries).alias("orders")).scalar()


def mask_transactions(df: DataFrame, keyring: KeyRing, config: EngineConfig) -> DataFrame:
    return mask(df, MaskPolicy.transactions(config), keyring, config)


def unmask_transactions(df: DataFrame, keyring: KeyRing, config: EngineConfig, **options) -> DataFrame:
    return unmask(df, MaskPolicy.transactions(config), keyring, config, **options)


def mask_customers(df: DataFrame, keyring: KeyRing, config: EngineConfig) -> DataFrame:
    return mask(df, MaskPolicy.customers(config), keyring, config)


def unmask_customers(df: DataFrame, keyring: KeyRing, config: EngineConfig, **options) -> DataFrame:
    return unmask(df, MaskPolicy.customers(config), keyring, config, **options)


def masked_literal(
    keyring: KeyRing, config: EngineConfig, field: str, value: str
) -> str:
    """Token of one plain value, to filter a masked table by equality.

    It is computed on one row up front, so that the filter is a literal the file scan can push down.
    """
    plain = keyring.spark.createDataFrame([(value,)], "value string")
    row = plain.withColumn("_keys", keyring.keys(config.mask_version)).select(
        crypto.encrypt(
            F.col("value"), F.lit(field), F.lit(config.mask_version), F.col("_keys"), config.domain
        ).alias("token")
    )
    return row.first()["token"]


#: Rows of a lookup table that may be sent to every task whatever the session's limit says.
BROADCAST_ROWS = 100_000


def permute_join(df: DataFrame, column: str, keyring: KeyRing, config: EngineConfig, inverse: bool = False) -> DataFrame:
    """Join form of the permutation: a lookup in a table of ``category_domain`` rows. Up to ``BROADCAST_ROWS`` it is broadcast;
    beyond, :func:`permute_number` needs no table. Values outside the domain become null."""
    if config.category_domain > BROADCAST_ROWS:
        return permute_number(df, column, config.category_domain, keyring, config, inverse)
    table = keyring.permutation_table(config.mask_version, config.category_domain)
    key, result = ("masked", "value") if inverse else ("value", "masked")
    lookup = table.select(F.col(key).alias("_key"), F.col(result).alias("_result"))
    joined = df.join(F.broadcast(lookup), F.col(column) == F.col("_key"), "left")
    return joined.select(
        *[F.col("_result").alias(column) if c == column else F.col(c) for c in df.columns]
    )


def permute_number(
    df: DataFrame, column: str, size: int, keyring: KeyRing, config: EngineConfig, inverse: bool = False
) -> DataFrame:
    """Permute integers of ``0..size-1``, for any size up to 2^60, row by row: no table and no join.

    It is another permutation than the one of :func:`mask`. Null and values outside the domain become null.
    """
    seeded = df.withColumn("_seed", keyring.seed(config.mask_version))
    out = [_keep_class(df, c, permutation.permute(F.col(c), size, F.col("_seed"), inverse)) if c == column else F.col(c) for c in df.columns]
    return seeded.select(*out)


def ranked(domain: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The distinct values of a column with their ``rank`` from 0 in ascending order, and how many there are; nulls are left out.

    Values are dealt to ranges, counted by range, and numbered within each; only the counts of the ranges meet in one task.
    """
    values = domain.select(F.col(column).alias("value")).where("value is not null").distinct()
    spread = values.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    path = shared_folder(domain.sparkSession, "ranked-domain")
    spread.write.parquet(path)
    spread = domain.sparkSession.read.schema(spread.schema).parquet(path)
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    table = spread.withColumn("own", own).join(F.broadcast(bases), "part")
    return table.select("value", (F.col("base") + F.col("own")).alias("rank")), spread.count()


def value_permutation(domain: DataFrame, column: str, keyring: KeyRing, config: EngineConfig) -> DataFrame:
    """A keyed bijection of the distinct values of any column onto themselves, as a table ``(value, masked)``.

    Each value's rank is permuted and leads to the value of that rank. The table has one row for each distinct value; join it by
    ``value`` to mask and by ``masked`` to restore, with :func:`veilspark.operators.lookup.lookup_join` where values are hot.
    """
    table, size = ranked(domain, column)
    if not size:
        return table.select("value", F.col("value").alias("masked"))
    moved = permute_number(table, "rank", size, keyring, config)
    return moved.join(table.select("rank", F.col("value").alias("masked")), "rank").select("value", "masked")
