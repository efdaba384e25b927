import pytest
from pyspark.sql import functions as F, types as T

from veilspark.functions.anonymizers import short_hash
from veilspark.functions.columns import canonical_text
from veilspark.operators import egress, masking
from veilspark.sources import schemas, sinks


def paths(df, destination, **options):
    return [r.path for r in egress.report(df, destination, **options).select(F.explode("violations").alias("v")).select("v.*").collect()]


def test_masked_record_passes(make, ring, config):
    masked = masking.mask_transactions(make(), ring, config)
    assert egress.guard(masked, "cloud").count() == 1
    assert paths(masked, "cloud") == []


def test_plain_field_is_stopped(make, ring, config):
    bad = masking.mask_transactions(make(), ring, config).withColumn(
        "email", F.lit("mona.keller@example.org").alias("email", metadata={schemas.KEY: "PII"})
    )
    bad = schemas.with_schema_classes(bad, schemas.MASKED_TRANSACTION)
    with pytest.raises(Exception, match="cloud egress blocked: field 'email'"):
        egress.guard(bad, "cloud").collect()
    assert paths(bad, "cloud") == ["email"]
    passed, quarantined = egress.guard(bad, "cloud", "split")
    assert (passed.count(), quarantined.count()) == (0, 1)
    assert quarantined.first().violations[0].rule == "must be masked ciphertext"


def test_guard_encrypts_once(make, ring, config):
    guarded = egress.guard(sinks.masked_output(masking.mask_transactions(make(), ring, config)), "cloud")
    assert guarded._jdf.queryExecution().executedPlan().toString().count("aesEncrypt") == 9
    reported = egress.report(masking.mask_transactions(make(), ring, config), "cloud").where(F.size("violations") > 0)
    assert reported._jdf.queryExecution().executedPlan().toString().count("aesEncrypt") == 9


def test_destinations_and_modes(make):
    with pytest.raises(ValueError):
        egress.guard(make(), "printer")
    with pytest.raises(ValueError):
        egress.guard(make(), "cloud", "ignore")


def test_unclassified_columns(make):
    df = make().withColumn("extra", F.lit("x"))
    assert "extra" not in paths(df, "llm")
    with pytest.raises(egress.EgressViolation):
        egress.guard(df, "cloud", strict=True)
    assert "extra" in paths(df, "llm", classes={"extra": "PII"})


def test_confidential_numbers(make):
    assert "amount" not in paths(make(), "cloud")
    assert "amount" in paths(make(), "llm")


def test_nested_and_lists(spark):
    inner = T.StructType([schemas.field("name", T.StringType(), "PII"), schemas.field("note", T.StringType(), "PUBLIC")])
    schema = T.StructType(
        [
            schemas.field("one", inner, "INTERNAL"),
            schemas.field("many", T.ArrayType(inner), "PII"),
            schemas.field("list", T.ArrayType(T.StringType()), "PII"),
            schemas.field("map", T.MapType(T.StringType(), T.StringType()), "PII"),
            schemas.field("absent", inner, "PII"),
        ]
    )
    good = "A" * 24
    df = spark.createDataFrame(
        [(("plain", "x"), [(good, "x"), ("plain", "x")], [good, "plain", None], {"k": "plain"}, None)], schema
    )
    assert sorted(paths(df, "cloud")) == ["list[1]", "many[1].name", "map{0}", "map{0}.key", "one.name"]


def test_shape_and_strict(spark):
    df = spark.createDataFrame([("A" * 24, "A" * 23, "has space" * 4)], T.StructType(
        [schemas.field(n, T.StringType(), "PII") for n in ("a", "b", "c")]))
    assert paths(df, "cloud") == ["b", "c"]


def leaks(spark, make, prompt, profile=None):
    df = make().withColumn("record", F.struct("*")).withColumn("prompt", F.lit(prompt))
    value = None if profile is None else F.lit(None)
    return df.select(egress.leaked_fields(F.col("prompt"), F.col("record"), value).alias("f")).first().f


def test_leak_check(spark, make):
    assert leaks(spark, make, "[[ENC|v1|a|AAAA]] fine") == []
    assert leaks(spark, make, "no token here") == ["prompt"]
    assert leaks(spark, make, "[[ENC| call MONA KELLER") == ["full_name"]
    assert leaks(spark, make, "[[ENC| 310.25 and 920.40") == ["amount", "available_balance"]
    assert leaks(spark, make, "[[ENC| 310.25") == ["amount"]
    assert leaks(spark, make, "[[ENC| QAR POS 5411") == []


def test_short_values_are_allowed(spark, make):
    df = make({"full_name": "Jo A"}).withColumn("record", F.struct("*"))
    row = df.select(egress.leaked_fields(F.lit("[[ENC| Jo A"), F.col("record")).alias("f")).first()
    assert row.f == []


def test_redaction_needs_a_salt(make):
    with pytest.raises(ValueError):
        egress.redact_for_log(make(), "")
    row = egress.redact_for_log(make({"phone": None}), "s").first()
    assert row.phone is None and row.merchant_name.startswith("NORTHSIDE") and row.email.startswith("[redacted:")
    assert len(row.email) == len("[redacted:]") + 12


def test_guarded_sink(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_guarded(sinks.masked_output(masking.mask_transactions(make(), ring, config)), path, "cloud")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception, match="egress blocked"):
        sinks.write_guarded(make(), str(tmp_path / "bad"), "cloud")


def test_strict_looks_into_records(spark):
    open_ = T.StructType([T.StructField("phone", T.StringType())])
    declared = T.StructType([schemas.field("phone", T.StringType(), "PII")])
    for kind in (lambda r: r, T.ArrayType, lambda r: T.MapType(T.StringType(), r)):
        bare = spark.createDataFrame([], T.StructType([schemas.field("box", kind(open_), "INTERNAL")]))
        with pytest.raises(egress.EgressViolation, match="box.phone"):
            egress.violations(bare, "cloud", strict=True)
        full = spark.createDataFrame([], T.StructType([schemas.field("box", kind(declared), "INTERNAL")]))
        egress.violations(full, "cloud", strict=True)


def test_records_in_containers_are_guarded_and_redacted(spark):
    inner = T.StructType([schemas.field("phone", T.StringType(), "PII"), schemas.field("note", T.StringType(), "PUBLIC")])
    schema = T.StructType(
        [
            schemas.field("map", T.MapType(T.StringType(), inner), "INTERNAL"),
            schemas.field("deep", T.ArrayType(T.ArrayType(inner)), "INTERNAL"),
        ]
    )
    df = spark.createDataFrame([({"k": ("plain", "x")}, [[("A" * 24, "x")], [("plain", "y")]]), (None, None)], schema)
    assert sorted(paths(df, "cloud")) == ["deep[1][0].phone", "map.k.phone"]
    hidden = egress.redact_for_log(df, "s").collect()
    assert hidden[0].map["k"].phone.startswith("[redacted:") and hidden[0].map["k"].note == "x"
    assert hidden[0].deep[1][0].phone.startswith("[redacted:") and tuple(hidden[1]) == (None, None)


def test_logged_fractions_are_hashed_as_they_are_tokenized(spark):
    rows = spark.createDataFrame([(1e10,), (None,)], "value double")
    seen = [r.value for r in egress.redact_for_log(rows, "salt", {"value": "PII"}).collect()]
    form = rows.select(short_hash(canonical_text(F.col("value"), "double"), "salt").alias("h")).first().h
    plain = rows.select(short_hash(F.lit("1.0E10"), "salt").alias("h")).first().h
    assert seen == [form, None] and form != plain
