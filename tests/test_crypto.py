import hashlib
import hmac
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veilspark.config import EngineConfig, MaskPolicy, Strategy, UnmaskDisabled
from veilspark.functions import crypto
from veilspark.keyring import KeyRing
from veilspark.operators import masking
from veilspark.sources import schemas


def test_hmac_known_answer(spark):
    """RFC 4231, case 1."""
    ring = KeyRing(spark, {"v1": b"\x0b" * 20 + b"\0" * 44})
    row = spark.createDataFrame([(bytearray(b"Hi There"),)], "m binary").select(
        F.hex(crypto.hmac_sha256(F.col("m"), ring.keys("v1"))).alias("h")
    )
    assert row.first().h.lower() == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"


def test_key_length_is_checked(spark):
    with pytest.raises(ValueError):
        KeyRing(spark, {"v1": b"short"})
    with pytest.raises(KeyError):
        KeyRing(spark, {"v1": bytes(64)}).keys("v9")


def test_keys_do_not_show_in_plans(make, ring, config, capsys):
    masking.mask_transactions(make(), ring, config).explain("extended")
    plan = capsys.readouterr().out
    from veilspark.plans import fixtures as fx

    for part in (fx.FIXTURE_KEY[:32], fx.FIXTURE_KEY[32:]):
        assert part.hex() not in plan.lower().replace(" ", "")
    assert KeyRing.derive_seed(fx.FIXTURE_KEY) not in plan


def test_masking_is_one_narrow_stage(make, ring, config):
    plan = masking.mask_transactions(make(), ring, config)._jdf.queryExecution().executedPlan().toString()
    outer = [line for line in plan.splitlines() if not line.lstrip(" :+-").startswith("Subquery")]
    assert "Join" not in plan
    assert plan.count("aesEncrypt") == 9
    assert not any("Exchange hashpartitioning" in line for line in outer)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=80), min_size=1, max_size=30))
def test_round_trip_and_injectivity(spark, ring, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("k", ring.keys("v1"))
    token = crypto.encrypt(F.col("v"), F.lit("f"), F.lit("v1"), F.col("k"), "d")
    rows = df.withColumn("t", token).select(
        "v", "t", crypto.is_ciphertext(F.col("t")).alias("shaped"),
        crypto.decrypt(F.col("t"), F.lit("f"), F.lit("v1"), F.col("k"), "d").alias("back"),
        crypto.decrypt(F.col("t"), F.lit("g"), F.lit("v1"), F.col("k"), "d").alias("other"),
    ).collect()
    assert all(r.back == r.v and r.other is None and r.shaped for r in rows)
    assert len({r.t for r in rows}) == len(set(values))


def test_mac_matches_an_independent_implementation(spark, ring):
    from veilspark.plans import fixtures as fx

    label = "d|v1|email"
    expected = hmac.new(
        fx.FIXTURE_KEY[:32], f"{len(label):08d}:{label}é@x".encode(), hashlib.sha256
    ).digest()[:16]
    row = spark.createDataFrame([("é@x",)], "v string").select(
        crypto.synthetic_iv(F.col("v"), F.lit("email"), F.lit("v1"), ring.keys("v1"), "d").alias("iv")
    )
    assert bytes(row.first().iv) == expected


def test_sample_record(make, ring, config):
    masked = masking.mask_transactions(make(), ring, config).first()
    assert masked.amount == pytest.approx(425.0425)
    assert masked.available_balance == pytest.approx(763.932)
    assert masked.credit_limit == pytest.approx(13320)
    assert masked.channel == "CH_ALPHA"
    assert masked.mask_version == "v1"
    assert masked.merchant_name == "NORTHSIDE BOOKS LINZ"
    assert masked.customer_id != "CUST-AT-00451907" and len(masked.customer_id) >= 24


def test_classes_survive_masking(make, ring, config):
    masked = masking.mask_transactions(make(), ring, config)
    classes = schemas.classes_of(masked.schema)
    assert classes["email"] == "PII" and classes["card_pan"] == "PCI" and classes["mask_version"] == "INTERNAL"


def test_out_of_domain_category_is_rejected(make, ring, config):
    for mcc in (10_000, -1):
        with pytest.raises(Exception, match="outside the permutation"):
            masking.mask_transactions(make({"mcc": mcc}), ring, config).select("mcc").collect()
    bad = masking.mask_transactions(make(), ring, config).withColumn("mcc", F.lit(-1))
    with pytest.raises(Exception, match="outside the permutation"):
        masking.unmask_transactions(bad, ring, config).collect()
    assert masking.unmask_transactions(bad, ring, config, on_error="null").first().mcc is None


def test_permutation_is_a_bijection(ring):
    table = ring.permutation_table("v1", 10_000)
    n, values, masked, low, high = table.agg(
        F.count("*"), F.countDistinct("value"), F.countDistinct("masked"), F.min("masked"), F.max("masked")
    ).first()
    assert (n, values, masked, low, high) == (10_000, 10_000, 10_000, 0, 9_999)


def test_unmask_needs_permission(make, ring, config):
    masked = masking.mask_transactions(make(), ring, config)
    with pytest.raises(UnmaskDisabled):
        masking.unmask_transactions(masked, ring, EngineConfig())
    with pytest.raises(UnmaskDisabled):
        EngineConfig(allow_unmask=True, allow_unmask_text=False).require_unmask_text()
    EngineConfig(allow_unmask=True).require_unmask_text()


def test_tampering_fails_or_gives_null(make, ring, config):
    masked = masking.mask_transactions(make(), ring, config)
    first = F.when(F.substring("email", 1, 1) == "A", "B").otherwise("A")
    flipped = masked.withColumn("email", F.concat(first, F.substring("email", 2, 500)))
    with pytest.raises(Exception, match="cannot decrypt email"):
        masking.unmask_transactions(flipped, ring, config).collect()
    row = masking.unmask_transactions(flipped, ring, config, on_error="null").first()
    assert row.email is None and row.phone == "+974 5512 3456"
    swapped = masked.withColumn("email", F.col("phone"))
    assert masking.unmask_transactions(swapped, ring, config, on_error="null").first().email is None


def test_nulls_stay_null(make, ring, config):
    masked = masking.mask_transactions(make({"email": None, "mcc": None, "amount": None}), ring, config)
    row = masked.first()
    assert row.email is None and row.mcc is None and row.amount is None
    assert masking.unmask_transactions(masked, ring, config).first().email is None


def test_dictionary_form_equals_inline_form(make, ring, config):
    df = make({}, {"transaction_id": "b", "email": None}, {"transaction_id": "c"}, {"transaction_id": "d", "phone": None})
    policy = MaskPolicy.transactions(config)
    columns = ["email", "phone", "full_name"]
    inline = masking.mask(df, policy, ring, config)
    shared = masking.mask_repeated(df, columns, policy, ring, config)
    assert sorted(map(tuple, shared.select(inline.columns).collect()), key=repr) == sorted(
        map(tuple, inline.collect()), key=repr
    )
    assert schemas.classes_of(shared.schema) == schemas.classes_of(inline.schema)
    back = masking.unmask_repeated(shared, columns, policy, ring, config, round_to=2)
    assert sorted(map(tuple, back.select(df.columns).collect()), key=repr) == sorted(
        map(tuple, df.collect()), key=repr
    )


def test_policy_from_a_table(spark, make, ring, config):
    table = spark.createDataFrame(
        [("email", "encrypt", None), ("amount", "scale", 2.0), ("channel", "map", None), ("absent", "encrypt", None)],
        "column string, strategy string, factor double",
    )
    row = masking.mask(make(), MaskPolicy.from_table(table, make(), config), ring, config).first()
    assert row.amount == 620.5 and row.channel == "CH_ALPHA" and row.phone == "+974 5512 3456"
    assert row.email != "mona.keller@example.org"
    with pytest.raises(ValueError, match="email"):
        MaskPolicy.from_table(table.unionAll(table), make(), config)
    with pytest.raises(ValueError):
        Strategy("shred")


def test_same_tokens_whatever_the_partitions(make, ring, config):
    df = make(*[{"transaction_id": str(i), "email": f"u{i % 5}@x.com"} for i in range(40)])
    one = masking.mask_transactions(df.coalesce(1), ring, config).select("transaction_id", "email")
    many = masking.mask_transactions(df.repartition(7), ring, config).select("transaction_id", "email")
    assert one.exceptAll(many).count() == 0
    assert one.select("email").distinct().count() == 5


def test_pushed_down_masked_predicate(spark, make, ring, config, tmp_path):
    path = str(tmp_path / "masked")
    masking.mask_transactions(make({}, {"email": "other@x.com"}), ring, config).write.parquet(path)
    token = masking.masked_literal(ring, config, "email", "other@x.com")
    found = spark.read.parquet(path).where(F.col("email") == token)
    assert found.count() == 1
    assert f"EqualTo(email,{token})" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 4098])
def test_network_is_a_bijection_of_any_size(spark, ring, config, size):
    df = spark.range(size).toDF("n")
    there = masking.permute_number(df.withColumn("was", F.col("n")), "n", size, ring, config)
    rows = there.collect()
    assert sorted(r.n for r in rows) == list(range(size))
    assert size < 100 or sum(r.n == r.was for r in rows) < size / 10
    back = masking.permute_number(there, "n", size, ring, config, inverse=True)
    assert all(r.n == r.was for r in back.collect())


def test_network_outside_its_domain_and_by_version(spark, ring, config):
    df = spark.createDataFrame([(None,), (-1,), (10**9,), (10**9 - 1,), (0,)], "n long")
    got = [r.n for r in masking.permute_number(df, "n", 10**9, ring, config).collect()]
    assert got[:3] == [None, None, None] and all(0 <= n < 10**9 for n in got[3:]) and got[3] != got[4]
    back = masking.permute_number(spark.createDataFrame([(n,) for n in got[3:]], "n long"), "n", 10**9, ring, config, inverse=True)
    assert [r.n for r in back.collect()] == [10**9 - 1, 0]
    with pytest.raises(ValueError):
        masking.permute_number(df, "n", 0, ring, config)


def test_text_domain(spark, ring, config):
    words = [f"w{i % 40}é" for i in range(200)] + [None, ""]
    table = masking.value_permutation(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), "w", ring, config).collect()
    assert sorted(r.value for r in table) == sorted(r.masked for r in table) == sorted({w for w in words if w is not None})
    assert sum(r.value == r.masked for r in table) < 10
    assert masking.value_permutation(spark.createDataFrame([], "w string"), "w", ring, config).count() == 0


def _sealed(spark, ring, config, values, spoil):
    """Rows of tokens, each with what :func:`crypto.decrypt` gives for it alone."""
    rows = spark.createDataFrame([(values,)], "v array<string>").withColumn("k", ring.keys("v1"))
    made = F.transform("v", lambda v: crypto.encrypt(v, F.lit("note"), F.lit("v1"), F.col("k"), config.domain))
    return rows.select("k", F.transform(made, spoil).alias("t"))


@pytest.mark.parametrize("bad", (None, 0, 20, 39))
@pytest.mark.parametrize("change", ("short", "other"))
def test_tokens_opened_together_are_those_opened_alone(spark, ring, config, bad, change):
    values = [None if i % 7 == 3 else "x" * i for i in range(40)]

    def spoil(token, i):
        end = F.left(token, F.length(token) - 8) if change == "short" else F.concat(F.left(token, F.length(token) - 8), F.lit("AAAAAAA="))
        return token if bad is None else F.when(i == bad, end).otherwise(token)

    rows = _sealed(spark, ring, config, values, spoil)
    field, version = F.lit("note").alias("field"), F.lit("v1").alias("version")
    sealed = F.transform("t", lambda t: F.struct(crypto.token_bytes(t).alias("raw"), field, version))
    together = crypto.decrypt_all(sealed, F.col("k"), config.domain)
    alone = F.transform("t", lambda t: crypto.decrypt(t, field, version, F.col("k"), config.domain))
    row = rows.select(together.alias("together"), alone.alias("alone")).first()
    assert row["together"] == row["alone"]
    assert row["together"] == [None if i == bad else v for i, v in enumerate(values)]


def test_masking_is_no_oversized_method(make, ring, config, capsys):
    """The JVM compiles methods of up to 8,000 bytes and interprets longer ones for each row."""
    masked = masking.mask_transactions(make(), ring, config)
    for df in (masked, masking.unmask_transactions(masked, ring, config)):
        df.explain("codegen")
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
        assert all(int(size) < 8000 for size in sizes)
