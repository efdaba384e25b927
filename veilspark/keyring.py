"""Versioned keys, handed to executors as a scalar subquery.

A literal key would be printed by ``explain``, in the UI and in event logs. A scalar subquery over a
small keyring table puts only the subquery's name in the plan, and every expression that needs the
key shares one evaluation of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEY_BYTES = 64
_SCHEMA = "version string, k_enc binary, k_ipad binary, k_opad binary, seed string"


def _hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pads of HMAC-SHA256 (RFC 2104) for a key of at most one block."""
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


class KeyRing:
    """One 64-byte key per mask version: 32 bytes to authenticate, 32 bytes to encrypt."""

    def __init__(
        self,
        spark: SparkSession,
        keys: Mapping[str, bytes],
        *,
        domain: str = "veilspark",
        seeds: Mapping[str, str] | None = None,
    ):
        if not keys:
            raise ValueError("a keyring needs at least one key")
        rows = []
        for version, key in sorted(keys.items()):
            if len(key) != KEY_BYTES:
                raise ValueError(f"the key of {version} must have {KEY_BYTES} bytes, got {len(key)}")
            ipad, opad = _hmac_pads(key[:32])
            seed = (seeds or {}).get(version) or self.derive_seed(key, domain)
            rows.append((version, bytearray(key[32:]), bytearray(ipad), bytearray(opad), seed))
        self.spark = spark
        self.versions = tuple(sorted(keys))
        self._table = spark.createDataFrame(rows, _SCHEMA)

    @staticmethod
    def derive_seed(key: bytes, domain: str = "veilspark") -> str:
        """Seed of the categorical permutation: the first 8 bytes of a hash over label and key."""
        digest = hashlib.sha256(f"{domain}|category-seed|".encode() + key).digest()
        return str(int.from_bytes(digest[:8], "big"))

    def _one(self, version: str) -> DataFrame:
        if version not in self.versions:
            raise KeyError(f"no key for mask version {version}")
        return self._table.where(F.col("version") == version)

    def keys(self, version: str) -> Column:
        """``struct<k_enc, k_ipad, k_opad>`` of one version.

        Subqueries may not appear inside higher-order functions, so add it as a column first when a
        lambda needs it.
        """
        return self._one(version).select(F.struct("k_enc", "k_ipad", "k_opad").alias("k")).scalar()

    def keys_by_version(self) -> Column:
        """``map<version, struct<k_enc, k_ipad, k_opad>>`` for values that carry their version."""
        entry = F.struct("version", F.struct("k_enc", "k_ipad", "k_opad"))
        return self._table.agg(F.map_from_entries(F.collect_list(entry)).alias("k")).scalar()

    def seed(self, version: str) -> Column:
        """Seed of the permutations of one version. As with :meth:`keys`, add it as a column before a lambda needs it."""
        return self._one(version).select("seed").scalar()

    def permutation(self, version: str, size: int) -> DataFrame:
        """One row: arrays ``forward`` and ``inverse`` of a seeded permutation of ``0..size-1``.

        The values are ordered by a keyed hash; a value's rank is its masked form. ``size`` is a
        setting, so the row does not grow with the data.
        """
        ranked = F.array_sort(
            F.transform(
                F.sequence(F.lit(0), F.lit(size - 1)),
                lambda m: F.struct(
                    F.sha2(F.concat(F.col("seed"), F.lit("|"), m.cast("string")), 256).alias("h"),
                    m.alias("m"),
                ),
            )
        )
        return (
            self._one(version)
            .select(F.transform(ranked, lambda r: r["m"]).alias("inverse"))
            .select(
                "inverse",
                F.transform(
                    F.array_sort(F.transform("inverse", lambda m, r: F.struct(m.alias("m"), r.alias("r")))),
                    lambda p: p["r"],
                ).alias("forward"),
            )
        )

    def permutation_table(self, version: str, size: int) -> DataFrame:
        """The same permutation as a lookup table ``(value, masked)`` of ``size`` rows."""
        return self.permutation(version, size).select(F.posexplode("forward").alias("value", "masked"))
