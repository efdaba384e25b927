"""Run a registered query and its SQL side by side and compare rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _norm(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (decimal.Decimal, float, int)):
        number = float(value)
        return "nan" if math.isnan(number) else number
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return repr(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def compare(spark_df, db, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    mine = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = db.execute(sql)
    theirs = _sorted_rows([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns differ: {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"row counts differ: {len(mine[1])} / {len(theirs[1])}\n{mine[1][:3]}\n{theirs[1][:3]}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"rows differ:\n{a}\n{b}"
    return None if mine[1] else "both sides are empty"
