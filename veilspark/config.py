"""Engine settings and column policies.

Operators never read environment variables; everything that changes a result is an argument or a
field of :class:`EngineConfig`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

# Masking defaults that results depend on.
SCALE_FACTORS = {"amount": 1.37, "available_balance": 0.83, "credit_limit": 1.11}
CHANNEL_MAP = {"POS": "CH_ALPHA", "ECOM": "CH_BETA", "ATM": "CH_GAMMA", "MOB": "CH_DELTA"}
TRANSACTION_ENCRYPTED = (
    "customer_id",
    "full_name",
    "phone",
    "email",
    "billing_address",
    "card_pan",
    "card_expiry",
    "ip_address",
    "device_id",
)
CUSTOMER_ENCRYPTED = ("customer_id", "full_name", "phone", "email", "address")
CATEGORY_DOMAIN = 10_000
VAULT_TTL_HOURS = 24
SCORE_THRESHOLD = 0.35


class UnmaskDisabled(PermissionError):
    """Raised when an unmask operator is called without permission."""


@dataclass(frozen=True)
class EngineConfig:
    """Settings shared by the operators."""

    mask_version: str = "v1"
    domain: str = "veilspark"
    scale_factors: dict[str, float] = field(default_factory=lambda: dict(SCALE_FACTORS))
    channel_map: dict[str, str] = field(default_factory=lambda: dict(CHANNEL_MAP))
    category_domain: int = CATEGORY_DOMAIN
    log_hash_salt: str = ""
    score_threshold: float = SCORE_THRESHOLD
    include_original: bool = False
    allow_unmask: bool = False
    allow_unmask_text: bool | None = None
    tracking_id_bytes: int = 8
    vault_ttl_hours: int = VAULT_TTL_HOURS

    def __post_init__(self) -> None:
        if not re.fullmatch(r"v\d+", self.mask_version):
            raise ValueError("mask_version must look like v1, v2, ...")
        if len(set(self.channel_map.values())) != len(self.channel_map):
            raise ValueError("channel_map must be one-to-one")
        if not 8 <= self.tracking_id_bytes <= 32:
            raise ValueError("tracking ids have 8 to 32 bytes")
        if any(factor == 0 for factor in self.scale_factors.values()):
            raise ValueError("scale factors must not be zero")

    def require_unmask(self) -> None:
        if not self.allow_unmask:
            raise UnmaskDisabled("unmasking is off; set allow_unmask=True")

    def require_unmask_text(self) -> None:
        allowed = self.allow_unmask if self.allow_unmask_text is None else self.allow_unmask_text
        if not allowed:
            raise UnmaskDisabled("text unmasking is off; set allow_unmask_text=True")


@dataclass(frozen=True)
class Strategy:
    """How one column is masked: ``encrypt``, ``scale``, ``permute`` or ``map``."""

    kind: str
    factor: float = 1.0
    mapping: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("encrypt", "scale", "permute", "map"):
            raise ValueError(f"unknown masking strategy: {self.kind}")


@dataclass(frozen=True)
class MaskPolicy:
    """Column name to :class:`Strategy`. Columns not named pass through unchanged."""

    columns: dict[str, Strategy]

    @classmethod
    def transactions(cls, config: EngineConfig) -> MaskPolicy:
        columns = {name: Strategy("encrypt") for name in TRANSACTION_ENCRYPTED}
        columns |= {name: Strategy("scale", factor=s) for name, s in config.scale_factors.items()}
        columns["mcc"] = Strategy("permute")
        columns["channel"] = Strategy("map", mapping=tuple(config.channel_map.items()))
        return cls(columns)

    @classmethod
    def customers(cls, config: EngineConfig) -> MaskPolicy:
        return cls({name: Strategy("encrypt") for name in CUSTOMER_ENCRYPTED})

    @classmethod
    def from_table(cls, policy: DataFrame, masked: DataFrame, config: EngineConfig) -> MaskPolicy:
        """Read the ``(column, strategy[, factor])`` rows that name columns of the table to be masked.

        Each column is named once at most, so what the driver reads is bounded by the table's columns.
        """
        named = policy.where(F.col("column").isin(masked.columns)).groupBy("column")
        rows = named.agg(F.count(F.lit(1)).alias("times"), F.first(F.struct("*")).alias("row")).collect()
        if twice := sorted(r["column"] for r in rows if r["times"] > 1):
            raise ValueError(f"columns with several policy rows: {', '.join(twice)}")
        columns = {}
        for found in rows:
            values = found["row"].asDict()
            columns[values["column"]] = Strategy(
                values["strategy"],
                factor=values.get("factor") or config.scale_factors.get(values["column"], 1.0),
                mapping=tuple(config.channel_map.items()) if values["strategy"] == "map" else (),
            )
        return cls(columns)
