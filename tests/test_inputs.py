import datetime
import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from veilspark.functions import recognizers as R
from veilspark.operators import reports, text, vault
from veilspark.plans import fixtures as fx


def tables(spark, folder, orders=40):
    """Order tables of one file with one row group each."""
    day = datetime.date(2024, 3, 1)
    rows = [(k, k % 5, 10.5 * k, day) for k in range(orders)]
    people = [(k, f"Customer#{k:09d}", 3, 12.5, "BUILDING") for k in range(5)]
    for name, data, schema in (
        ("orders", rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date"),
        ("customer", people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        ("nation", [(3, "CANADA")], "n_nationkey int, n_name string"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_transactions_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    tables(spark, str(tmp_path))
    rows = fx.transactions(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.select("transaction_id").distinct().count() == rows.count() == 40


def test_text_stream_reads_a_folder_of_part_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.co", "en"), (2, "", "en"), (3, None, "de")], "doc_id long, text string, lang string")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.anonymized_text for r in entry.queries()["stream_anonymize"](spark, str(tmp_path)).collect()}
    assert found == {1: "mail <EMAIL_ADDRESS>", 2: "", 3: None}


def test_recognizers_search_a_text_once(spark):
    """Settling overlaps uses what was found instead of searching again."""
    df = spark.createDataFrame([("mail a@b.co",)], "text string")
    plan = text.analyze(df, registry=(R.EMAIL, R.CUSTOMER_ID)).select("entities")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    assert "RLIKE" not in plan


def test_leak_index_tells_numbered_values_apart(spark):
    """Values that differ in a few digits only: each is found once, and the index does not lead a text to all of them."""
    values = spark.createDataFrame([(f"customer#{k:06d}",) for k in range(2000)] + [("ab123",), ("abcd",), (None,)], "v string")
    rows = [(1, "xCUSTOMER#000123y 000124 customer#"), (2, "AB123"), (3, "000125 000126"), (4, None), (None, "customer#001999")]
    got = reports.corpus_leaks(spark.createDataFrame(rows, "id int, text string"), "id", "text", values, "v").collect()
    assert sorted((str(r.id), r.value) for r in got) == [("1", "customer#000123"), ("2", "ab123"), ("None", "customer#001999")]
    index = reports._rarest_grams(values.select(F.col("v").alias("value")).where("length(v) >= 5"), 5)
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] == 1


def _ciphers(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("aesencrypt") + df._jdf.queryExecution().executedPlan().toString().count("aesEncrypt")


def test_both_sides_of_a_split_read_ciphers_made_once(spark, tmp_path):
    tables(spark, str(tmp_path))
    split = entry.queries()["egress_split"](spark, str(tmp_path))
    assert _ciphers(split) == 0
    assert {r.outcome: (r.n, r.ids) for r in split.collect()} == {"passed": (30, 30), "quarantined": (10, 10)}


def test_a_repeated_vault_run_writes_ciphers_made_once(spark, tmp_path, monkeypatch):
    tables(spark, str(tmp_path))
    written, write = [], vault.write_vault
    monkeypatch.setattr(vault, "write_vault", lambda rows, *rest: written.append(_ciphers(rows)) or write(rows, *rest))
    found = entry.queries()["sink_vault"](spark, str(tmp_path)).first()
    assert (found.n, found.ids, found.dates) == (40, 40, 1)
    assert written == [0, 0]


def test_customers_are_made_once_and_not_for_each_order(spark, tmp_path):
    """Customers without orders, keys without a customer and null keys are left out; rows that come twice count once."""
    folder, day = str(tmp_path), datetime.date(2024, 3, 1)
    tables(spark, folder)
    orders = [(k, c, 1.0, day) for k, c in enumerate([1, 1, 1, 2, 2, 4, 9, None, None])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date").write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    people = [(1, "Ann", 3, 1.0, "BUILDING"), (2, "Bo", 3, 1.0, "MACHINERY"), (2, "Bo", 3, 2.0, "MACHINERY"), (3, "Cy", 3, 1.0, "MACHINERY"), (4, "Di", 3, 1.0, None)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.mode("overwrite").parquet(
        f"{folder}/customer.parquet"
    )
    for made, want in ((fx.customers(spark, folder), ["Ann", "Bo", "Di"]), (fx.profiles(spark, folder), ["Profile Bo"])):
        assert sorted(r.full_name for r in made.collect()) == want
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [o_custkey" in plan and "RepartitionByExpression" not in plan


def test_columns_are_searched_once_and_without_places(spark):
    """What a column holds needs no spans, and the plan does not grow with the columns."""
    rows = [("a@b.co", "card 4111 1111 1111 1111"), ("x", "4111 1111 1111 1112"), (None, "a@b.co +974 5512 3456"), ("", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    found = reports.column_discovery(df, None, (R.EMAIL, R.CREDIT_CARD, R.INTERNATIONAL_PHONE))
    got = {(r.column, r.entity_type): (r.n, r["values"], r.share) for r in found.collect()}
    assert got == {
        ("a", "EMAIL_ADDRESS"): (1, 3, 1 / 3), ("b", "EMAIL_ADDRESS"): (1, 3, 1 / 3),
        ("b", "CREDIT_CARD"): (1, 3, 1 / 3), ("b", "PHONE_NUMBER"): (1, 3, 1 / 3),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("LogicalRDD") == 1
    assert reports.column_discovery(df, None, ()).collect() == []


def test_types_of_columns_are_those_of_their_spans(spark):
    """At thresholds below, between and above the scores with and without context."""
    rnd = random.Random(5)
    parts = ["email", "a@b.co", "card", "4111 1111 1111 1111", "4111111111111112", "id", "CUST-1234567", "+974 5512 3456", "call", "ſ@k.ıo", "x"]
    values = [(None,), ("",)] + [(" ".join(rnd.choice(parts) for _ in range(rnd.randrange(9))),) for _ in range(150)]
    df = spark.createDataFrame(values, "text string")
    low = R.Recognizer("CUSTOMER_ID", r"\bCUST-\d+", 0.2, ("id",))
    registry = (R.EMAIL, R.CREDIT_CARD, R.INTERNATIONAL_PHONE, low, R.Recognizer("EMAIL_ADDRESS", r"mail", 0.1))
    for threshold in (0.0, 0.35, 0.5, 0.75, 1.0):
        held = R.types_held(F.col("text"), registry, threshold)
        spans = F.coalesce(R.recognize(F.col("text"), registry), F.array())
        types = F.array_distinct(F.transform(F.filter(spans, lambda s: s["score"] >= threshold), lambda s: s["entity_type"]))
        both = df.select(F.array_sort(types).alias("a"), F.array_compact(F.array(*[F.when(c, t) for t, c in sorted(held.items())])).alias("b"))
        rows = both.collect()
        assert all(r.a == r.b for r in rows) and (any(r.a for r in rows))
