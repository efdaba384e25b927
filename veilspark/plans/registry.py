"""Registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.functions import permutation
from veilspark.keyring import _hmac_pads
from veilspark.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def with_inputs(body: str, *, customers: bool = False, profiles: bool = False) -> str:
    """Prefix SQL with the derived input tables."""
    parts = [f"transactions AS ({fx.TRANSACTIONS})"]
    if customers:
        parts.append(f"customers AS ({fx.CUSTOMERS})")
    if profiles:
        parts.append(f"profiles AS ({fx.PROFILES})")
    return f"WITH {', '.join(parts)} {body}"


def sql_hmac(message: str) -> str:
    """HMAC-SHA256 under the fixture key in DuckDB SQL, as lower-case hex."""
    inner, outer = (pad.hex() for pad in _hmac_pads(fx.FIXTURE_KEY[:32]))
    return (
        f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"
    )


def sql_iv(value: str, field: str) -> str:
    """Synthetic IV of a value as upper-case hex."""
    label = f"veilspark|v1|{field}"
    return f"upper(substr({sql_hmac(f''' '{len(label):08d}:{label}' || {value} ''')}, 1, 32))"


def sql_tracking_id(record_id: str, run: str = "", digits: int = 16) -> str:
    return f"'MASK-' || upper(substr({sql_hmac(f''' 'tracking-id|{run}|' || {record_id} ''')}, 1, {digits}))"


#: The permutation as a table, ranked by SQL's own window.
PERMUTATION = (
    "SELECT m AS value, row_number() OVER (ORDER BY sha256(concat("
    f"'{fx.KeyRing.derive_seed(fx.FIXTURE_KEY)}', '|', m)), m) - 1 AS masked FROM range(10000) t(m)"
)


def sql_network(source: str, columns: str, value: str, size: int, turns: int = 3) -> str:
    """SQL for the table-free permutation: ``columns`` and ``value`` of ``source``, permuted by its own unrolled rounds.

    Values are below the size after the first turn but for a few; more than ``turns`` do not occur in the tables at hand, and would
    show as a difference.
    """
    low, high = permutation.bases(size)
    seed = fx.KeyRing.derive_seed(fx.FIXTURE_KEY)
    text = f"(SELECT {columns}, CAST({value} AS BIGINT) AS x FROM {source})"
    for turn in range(turns):
        text = f"(SELECT {columns}, x, x % {low} AS l, x // {low} AS h FROM {text})"
        for number in range(1, permutation.ROUNDS + 1):
            digit, base, other = ("l", low, "h") if number % 2 else ("h", high, "l")
            move = f"CAST('0x' || substr(sha256(concat('{seed}', '|', {number}, '|', {other})), 1, 15) AS BIGINT)"
            text = f"(SELECT {columns}, x, {other}, ({digit} + {move} % {base}) % {base} AS {digit} FROM {text})"
        again = f"CASE WHEN x < {size} THEN x ELSE l + h * {low} END" if turn else f"l + h * {low}"
        text = f"(SELECT {columns}, {again} AS x FROM {text})"
    return f"SELECT {columns}, x AS {value} FROM {text}"
