"""All registered queries."""

from veilspark.plans import guard_queries, job_queries, masking_queries, text_queries  # noqa: F401
from veilspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
