import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE
from veilspark.functions import columns as C, crypto
from veilspark.operators import lookup, scoring, validation, vault
from veilspark.plans import fixtures as fx, jobs
from veilspark.sources import readers, schemas, sinks
from veilspark.sources.storage import shared_folder


def broken(df):
    return validation.validate(df, validation.transaction_rules()).first().violations


BROKEN = [
    ({"mcc": 10_000}, "mcc_range"),
    ({"mcc": -1}, "mcc_range"),
    ({"currency": "QA"}, "currency_length"),
    ({"amount": -0.01}, "amount_not_negative"),
    ({"credit_limit": -1.0}, "credit_limit_not_negative"),
    ({"transaction_ts": "bad"}, "timestamp_parseable"),
    ({"channel": "WEB"}, "channel_known"),
    ({"email": None}, "email_required"),
]


def test_rules(make):
    changed = [{**change, "transaction_id": str(i)} for i, (change, _) in enumerate(BROKEN)]
    rows = validation.validate(make(*changed), validation.transaction_rules()).orderBy("transaction_id").collect()
    assert [r.violations for r in rows] == [[rule] for _, rule in BROKEN]


def test_valid_rows(make):
    assert broken(make()) == []
    assert broken(make({"available_balance": -5.0})) == []
    valid, rejected = validation.split(
        validation.validate(make({}, {"mcc": -1}), validation.transaction_rules())
    )
    assert (valid.count(), rejected.count()) == (1, 1)


TIMESTAMPS = [
    ("2026-01-20", True),
    ("2026-01-20T10:15:30Z", True),
    ("2026-01-20 10:15", True),
    ("2026-01-20T10:15:30.123456+03:00", True),
    ("20260120T101530", True),
    ("20260120", True),
    ("2026-02-30", False),
    ("2026-1-2", False),
    ("2026", False),
    ("2026-01-20T25:00", False),
    ("2026-01-20T10:61", False),
    ("20 January 2026", False),
    ("", False),
]


def test_timestamps(spark):
    df = spark.createDataFrame(TIMESTAMPS, "v string, expected boolean")
    rows = df.select(
        "v", "expected", validation.is_iso_timestamp(F.col("v")).alias("ok"),
        validation.event_time(F.col("v")).alias("t"),
    ).collect()
    assert [(r.v, r.ok) for r in rows] == TIMESTAMPS
    assert all(r.t is not None for r in rows if r.ok)


def test_json_records(spark):
    lines = [
        SAMPLE,
        {**SAMPLE, "mcc": "5411", "amount": "310.25", "is_card_present": "yes"},
        {**SAMPLE, "mcc": 5411.0},
        {**SAMPLE, "mcc": "abc", "phone": 974},
        {**SAMPLE, "mcc": 54.5, "is_card_present": 7},
        {k: v for k, v in SAMPLE.items() if k != "email"},
        {**SAMPLE, "email": None},
    ]
    texts = [json.dumps(x) for x in lines] + ["{broken", "[1, 2]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    rows = readers.parse_json(df, "value", schemas.TRANSACTION).orderBy("i").collect()
    assert [r.type_errors for r in rows] == [
        [], [], [], ["phone", "mcc"], ["mcc", "is_card_present"], [], [], ["record"], ["record"],
    ]
    assert [r.mcc for r in rows[:3]] == [5942, 5411, 5411] and rows[1].amount == 310.25 and rows[1].is_card_present is True
    assert rows[5].email is None and rows[6].email is None


def test_conform_and_files(spark, make, tmp_path):
    path = str(tmp_path / "t")
    make().withColumn("mcc", F.lit("x")).write.parquet(path)
    row = readers.read_records(spark, path, schemas.TRANSACTION).first()
    assert row.mcc is None and row.type_errors == ["mcc"]
    jpath = str(tmp_path / "j")
    make().write.json(jpath)
    assert readers.read_records(spark, jpath, schemas.TRANSACTION, "json").first().type_errors == []


def test_predictions_default(spark):
    df = spark.createDataFrame([("a", 0.5)], "masked_id string, fraud_probability double")
    assert readers.prediction_source(df).first().model_version == "fraud-detector-v2.1"


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.29, 0.30, 0.69, 0.70, None)], "p double")
    rows = df.select(C.recommendation(F.col("p")).alias("r"), C.risk_level(F.col("p")).alias("l")).collect()
    assert [r.l for r in rows] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", None]
    assert [r.r and r.r.split()[0] for r in rows] == ["APPROVE", "REVIEW", "REVIEW", "DECLINE", None]


def test_tracking_ids(spark, make, ring, config):
    df = make({}, {"transaction_id": "b"})
    ids = [r.masked_id for r in vault.with_tracking_id(df, ring, config).collect()]
    assert all(len(i) == 21 and i.startswith("MASK-") and i == i.upper() for i in ids) and len(set(ids)) == 2
    again = [r.masked_id for r in vault.with_tracking_id(df, ring, config).collect()]
    other = [r.masked_id for r in vault.with_tracking_id(df, ring, config, "run2").collect()]
    assert ids == again and not set(ids) & set(other)
    random = spark.range(50).select(crypto.random_tracking_id().alias("i")).collect()
    assert len({r.i for r in random}) == 50 and all(len(r.i) == 21 for r in random)


def test_vault_round_trip(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "vault")
    df = make({}, {"transaction_id": "b", "card_pan": "4000000000000002"})
    for _ in range(2):
        masked = vault.mask_and_track(df, path, "r1", ring, config, F.lit("2026-01-20 10:00:00"))
    vault.mask_and_track(make({"transaction_id": "c"}), path, "r2", ring, config, F.lit("2026-01-21 23:00:00"))
    assert masked.count() == 2 and spark.read.parquet(path).count() == 3
    predictions = scoring.cloud_predictions(masked)
    stored = vault.read_vault(spark, path)
    restored = vault.restore_identity(predictions, stored).orderBy("transaction_id").collect()
    assert [r.card_pan_last4 for r in restored] == ["4444", "0002"]
    assert restored[0].recommendation.startswith("DECLINE") and restored[0].amount_original == 310.25
    unknown = spark.createDataFrame([("MASK-0", 0.1, "m")], schemas.PREDICTION)
    assert vault.restore_identity(unknown, stored).count() == 0
    assert vault.unmatched(unknown.unionAll(predictions), stored).count() == 1
    one = masked.first().masked_id
    assert vault.original_of(stored, one).count() == 1
    assert vault.masked_of(stored, one).first().mask_version == "v1"


def test_vault_expiry_is_strict(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "vault")
    vault.mask_and_track(make(), path, "r1", ring, config, F.lit("2026-01-20 10:00:00"))
    at = lambda t: vault.read_vault(spark, path, F.lit(t), 24).count()
    assert (at("2026-01-21 10:00:00"), at("2026-01-21 10:00:01")) == (1, 0)
    assert vault.expired_dates(spark, path, "2026-01-22 00:00:00", 24) .count() == 1
    assert vault.expired_dates(spark, path, "2026-01-21 09:00:00", 24).count() == 0


def test_expiry_prunes_partitions(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "vault")
    vault.mask_and_track(make(), path, "r1", ring, config, F.lit("2026-01-20 10:00:00"))
    plan = vault.read_vault(spark, path, F.lit("2026-01-21 10:00:00"), 24).select("masked_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in text


def test_restore_reads_needed_fields_only(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "vault")
    masked = vault.mask_and_track(make(), path, "r1", ring, config, F.lit("2026-01-20 10:00:00"))
    plan = vault.restore_identity(scoring.cloud_predictions(masked), vault.read_vault(spark, path))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "billing_address" not in text


def test_profile_is_chosen_per_record(spark, make):
    profile = spark.createDataFrame(
        [("CUST-AT-00451907", "Profile Name", None, "p@x.com", "There", "GOLD", "EN")], schemas.CUSTOMER
    )
    df = make({}, {"transaction_id": "b", "customer_id": "CUST-AT-1111111"})
    for split_hot in (False, True):
        joined = scoring.with_profile(df, profile, split_hot)
        rows = joined.orderBy("transaction_id").select(*[c.alias(n) for n, c in scoring.contact(joined).items()]).collect()
        assert tuple(rows[0]) == ("Profile Name", None, "p@x.com", "There")
        assert rows[1].full_name == "Mona Keller" and rows[1].phone == "+974 5512 3456"


def test_hot_keys_do_not_change_joins(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.col("id")
    )
    table = spark.createDataFrame([("hot", 0)] + [(f"k{i}", i) for i in range(30)], "k string, v int")
    for how in ("inner", "left"):
        plain = lookup.lookup_join(facts, table, "k", how)
        spread = lookup.lookup_join(facts, table, "k", how, split_hot=True)
        assert plain.count() == spread.count()
        pieces = {r.pieces for r in lookup.hot_pieces(facts.where("k = 'hot'"), "k").collect()}
        assert pieces == {int(spark.conf.get("spark.sql.shuffle.partitions"))}
        assert plain.select("k", "id", "v").exceptAll(spread.select("k", "id", "v")).count() == 0


def test_shared_folder(spark):
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_jobs_on_the_sample(spark, make, ring, config):
    none = spark.createDataFrame([], schemas.CUSTOMER)
    explained = jobs.explain_transactions(make(), none, ring, config, F.lit(0.75)).first()
    assert explained.unmasked_result.rm_explanation == (
        "Transaction by Mona Keller for 310.25 at NORTHSIDE BOOKS LINZ on 2027-03-08T06:42:11+01:00 received "
        "fraud score 75%. Reasons: DEVICE_NEW, AMOUNT_SPIKE, GEO_MISMATCH. Customer contact: +974 5512 3456, "
        "mona.keller@example.org."
    )
    run = jobs.full_artifacts(
        make(), none, shared_folder(spark, "vault"), "r1", ring, config, F.lit("2026-01-20 10:00:00"), F.lit(0.75)
    ).first()
    found = {e.entity_type for e in run.input_scan.entities}
    assert {"EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "CUSTOMER_ID"} <= found
    assert run.preflight_scan.entity_count == 0 and len(run.request.tokens) == 7
    assert run._fraud_scoring.risk_level == "HIGH"
    assert run.cloud_payload.amount == pytest.approx(425.0425)
    assert "Mona" not in run.request.prompt
    locked = fx.config().__class__(log_hash_salt="s")
    assert "unmasked_result" not in jobs.explain_transactions(make(), none, ring, locked, F.lit(0.75)).columns


def test_a_leaking_row_stops_only_itself(spark, make, ring, config, tmp_path):
    none = spark.createDataFrame([], schemas.CUSTOMER)
    rows = make({"transaction_id": "A"}, {"transaction_id": "B", "billing_address": "contact"})
    explained = jobs.explain_transactions(rows, none, ring, config, F.lit(0.2))
    good, bad = (str(tmp_path / name) for name in ("good", "bad"))
    assert sinks.write_routed(explained, good, bad) == {"passed": 1, "blocked": 1}
    passed, blocked = spark.read.parquet(good).first(), spark.read.parquet(bad).first()
    assert passed.original.transaction_id == "A" and "Mona Keller" in passed.unmasked_result.rm_explanation
    assert blocked.original.transaction_id == "B" and blocked.blocked == "llm egress blocked: plaintext of 'billing_address'"
    assert blocked.masked_result is None and blocked.unmasked_result is None and blocked.unmask_warning is None
    assert sinks.write_routed(explained.limit(0), good, bad) == {"passed": 0, "blocked": 0}
    with pytest.raises(ValueError):
        sinks.write_routed(explained, good, good + "/bad")


def test_a_lookup_reads_one_prefix_folder(spark, make, ring, config, tmp_path):
    path, long_ids = str(tmp_path / "vault"), replace(config, tracking_id_bytes=16)
    df = make(*[{"transaction_id": str(i)} for i in range(60)])
    rows = vault.vault_rows(df, ring, long_ids, F.lit("2026-01-20 10:00:00"))
    vault.write_vault(rows, path, "r1", prefix_digits=1, refuse_collisions=True)
    stored = vault.read_vault(spark, path)
    wanted = stored.select("masked_id", F.col("original.transaction_id").alias("t")).first()
    assert len(wanted.masked_id) == len("MASK-") + 32
    found = vault.original_of(stored, wanted.masked_id)
    assert [r.transaction_id for r in found.collect()] == [wanted.t]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numPartitions").value() == 1
    assert len({f.split("id_prefix=")[1][:2] for f in stored.inputFiles()}) > 8
    assert vault.masked_of(stored, "MASK-NONE").count() == 0


def test_a_collision_is_refused_before_the_write(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "vault")
    rows = vault.vault_rows(make({"transaction_id": "a"}, {"transaction_id": "b"}), ring, config, F.lit("2026-01-20 10:00:00"))
    with pytest.raises(ValueError, match="share the id"):
        vault.write_vault(rows.withColumn("masked_id", F.lit("MASK-1")), path, "r1", refuse_collisions=True)
    assert not (tmp_path / "vault").exists()
    again = rows.unionAll(rows)  # the same record twice shares its id rightly
    vault.write_vault(again, path, "r1", refuse_collisions=True)
    assert spark.read.parquet(path).count() == 4


def test_conform_refuses_what_does_not_fit(spark, make):
    row = readers.conform(make().withColumn("mcc", F.lit(5411.7)).withColumn("phone", F.lit(974)), schemas.TRANSACTION).first()
    assert row.mcc is None and row.phone is None and row.type_errors == ["phone", "mcc"]
    assert readers.conform(make().withColumn("mcc", F.lit(5411.0)), schemas.TRANSACTION).first().mcc == 5411


def test_not_a_number_is_no_amount(make):
    rows = validation.validate(make({"amount": float("nan")}), validation.transaction_rules())
    assert rows.first().violations == ["amount_not_negative"]


def test_vault_files_keep_the_order_of_ids(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "vault")
    df = make(*[{"transaction_id": str(i)} for i in range(60)]).repartition(3)
    day = F.when(F.col("transaction_id").cast("int") % 2 == 0, "2026-01-20 10:00:00").otherwise("2026-01-21 10:00:00")
    vault.write_vault(vault.vault_rows(df, ring, config, day), path, "r1")
    files = spark.read.parquet(path).inputFiles()
    ids = [[r.masked_id for r in spark.read.parquet(f).collect()] for f in files]
    assert len(files) == 6 and all(x == sorted(x) for x in ids)
    with pytest.raises(ValueError):
        vault.write_vault(vault.vault_rows(df, ring, config, day), path, "../other")
