"""Spark operators that mask, detect, tokenize and guard sensitive data."""

from veilspark.config import EngineConfig, MaskPolicy, Strategy
from veilspark.keyring import KeyRing

__all__ = ["EngineConfig", "KeyRing", "MaskPolicy", "Strategy"]
