"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The tables that the queries read are stored once, in a
file per core and row group, so that small single files do not keep all but one core waiting. Each query runs once to warm up and
then ``BENCH_RUNS`` times; the best run counts. Rows go to Spark's noop sink, so every column of every
row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "validate_rules",
    "mask_transactions",
    "mask_transactions_by_dictionary",
    "unmask_transactions",
    "unmask_transactions_by_dictionary",
    "permute_category",
    "join_masked_tables",
    "restore_identity",
    "customer_profile_lookup",
    "detect_entities",
    "anonymize_replace",
    "entity_profile_by_language",
    "detect_names_and_places",
    "unmask_text_values",
    "egress_audit",
    "redact_for_log",
    "corpus_leaks",
    "job_explain",
)


def session(cores: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def stored(spark: SparkSession, sf_dir: str, files: int) -> str:
    """A copy of the tables in several files each."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in Path(sf_dir).glob("*.parquet"):
        rows = spark.read.parquet(str(path))
        rows.repartition(files if rows.count() > 1000 else 1).write.parquet(f"{folder}/{path.name}")
    return folder


def main() -> None:
    from veilspark.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    sf_name, sf_dir = sf_dir, stored(spark, sf_dir, int(cores))
    seconds: dict[str, float] = {}
    for name in chosen:
        best = None
        for run in range(runs + 1):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            if run and (best is None or taken < best):
                best = taken
        seconds[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {
        "mask_transactions": orders,
        "mask_transactions_by_dictionary": orders,
        "unmask_transactions": orders,
        "detect_entities": documents,
        "anonymize_replace": documents,
        "egress_audit": orders,
        "restore_identity": orders,
    }
    print(
        json.dumps(
            {
                "metric": "headline query time, warm, best run",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": {n: round(r / seconds[n]) for n, r in rates.items() if n in seconds},
                "sf": sf_name.rstrip("/").rsplit("sf", 1)[-1],
                "cores": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
