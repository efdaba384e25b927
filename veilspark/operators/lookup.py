"""Joins of a large table to a lookup that has each key at most once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

def hot_pieces(df: DataFrame, key: str) -> DataFrame:
    """Keys with more rows than an even share of a partition, as ``code`` (their hash) and the ``pieces`` they need.

    Keys are counted before the shuffle. At most as many keys as there are partitions can exceed the share, so the
    table is small at any size; a key that shares a hot hash counts as hot too, which does no harm.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.xxhash64(key).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(counts.agg(F.sum("n")).scalar() / partitions)
    return counts.where(F.col("n") > share).select("code", F.ceil(F.col("n") / share).cast("int").alias("pieces"))


def _with_pieces(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    pieces = F.broadcast(hot.select(F.col("code").alias("_code"), F.col("pieces").alias("_pieces")))
    return df.join(pieces, F.xxhash64(key) == F.col("_code"), "left").drop("_code")


def salted(facts: DataFrame, key: str, hot: DataFrame, *columns: str) -> DataFrame:
    """Facts with the piece of their key. The row itself decides, so a retried task puts it in the same place."""
    piece = F.pmod(F.xxhash64(*columns), F.coalesce(F.col("_pieces"), F.lit(1))).cast("int")
    return _with_pieces(facts, key, hot).withColumn("_salt", piece).drop("_pieces")


def repeated(lookup: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Lookup rows, once for each piece of their key."""
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    return _with_pieces(lookup, key, hot).withColumn("_salt", F.explode(pieces)).drop("_pieces")


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", split_hot: bool = False
) -> DataFrame:
    """Join facts to a unique-key lookup; Spark broadcasts a small lookup and otherwise sorts and merges.

    Adaptive execution splits skewed partitions at run time. With ``split_hot`` the keys with more rows than an even
    share of a partition are spread over as many pieces as they hold shares, and only their lookup rows are
    repeated. Which keys these are never changes the result.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if not split_hot:
        return facts.join(lookup, key, how)
    hot = hot_pieces(facts, key)
    return salted(facts, key, hot, *facts.columns).join(repeated(lookup, key, hot), [key, "_salt"], how).drop("_salt")


def via_dictionary(
    df: DataFrame, columns: list[str], compute: Callable[[DataFrame], DataFrame], split_hot: bool = True
) -> DataFrame:
    """Replace columns by a costly function of them, computed once per distinct combination.

    Distinct combinations are reduced before they are shuffled, computed, and joined back by value;
    one that most rows share is spread (see :func:`lookup_join`). Pays off where values repeat often,
    as customer columns do in transactions. ``compute`` maps the columns and may add others. ``df`` is
    read several times, so it should be a stored table rather than the end of a long computation.
    """
    distinct = df.select(*columns).distinct().withColumn("_key", F.struct(*columns))
    computed = compute(distinct)
    added = [c for c in computed.columns if c != "_key"]
    dictionary = computed.select("_key", F.struct(*added).alias("_computed"))
    others = [c for c in df.columns if c not in columns]
    keyed = df.select(*others, F.struct(*columns).alias("_key"))
    joined = lookup_join(keyed, dictionary, "_key", "inner", split_hot)
    kept = [F.col(f"_computed.{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*kept, *[F.col(f"_computed.{c}").alias(c) for c in added if c not in df.columns])
