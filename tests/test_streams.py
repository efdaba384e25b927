from pyspark.sql import functions as F

from veilspark.config import MaskPolicy
from veilspark.operators import masking, text, vault
from veilspark.sources import readers, schemas
from veilspark.streaming import streams


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_equals_batch(spark, make, ring, config, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = make(*[{"transaction_id": str(i), "email": f"u{i}@x.com"} for i in range(30)])
    df.repartition(3).write.parquet(source)
    stream = readers.read_record_stream(spark, source, schemas.TRANSACTION, df.schema, maxFilesPerTrigger=1)
    masked = streams.mask_stream(stream.drop("type_errors"), MaskPolicy.transactions(config), ring, config)
    drain(streams.file_writer(masked, out, str(tmp_path / "ck")))
    batch = masking.mask_transactions(df, ring, config)
    assert batch.exceptAll(spark.read.parquet(out).select(batch.columns)).count() == 0


def test_text_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "mail a@b.co"), (2, ""), (3, "nothing")], "id int, text string")
    df.write.parquet(source)
    done = streams.anonymize_stream(spark.readStream.schema(df.schema).parquet(source))
    drain(streams.file_writer(done.select("id", "anonymized_text"), out, str(tmp_path / "ck")))
    batch = text.anonymize(df).select("id", "anonymized_text")
    assert batch.exceptAll(spark.read.parquet(out)).count() == 0


def test_late_scores_come_out_unmatched(spark, make, ring, config, tmp_path):
    stored = vault.vault_rows(
        make({}, {"transaction_id": "b"}), ring, config, F.lit("2026-01-20 10:00:00")
    )
    ids = {r.t: r.masked_id for r in stored.select("masked_id", F.col("original.transaction_id").alias("t")).collect()}
    first, second = ids["TXN-20270308-000417"], ids["b"]
    vault_dir, score_dir, out = (str(tmp_path / n) for n in ("vault", "scores", "out"))
    stored.write.parquet(vault_dir)
    schema = "masked_id string, fraud_probability double, model_version string, predicted_at timestamp"

    def scores(*rows):
        spark.createDataFrame(rows, "masked_id string, fraud_probability double, model_version string, at string").select(
            "masked_id", "fraud_probability", "model_version", F.col("at").cast("timestamp").alias("predicted_at")
        ).coalesce(1).write.mode("append").parquet(score_dir)

    def step():
        joined = streams.restore_stream(
            spark.readStream.schema(schema).parquet(score_dir), spark.readStream.schema(stored.schema).parquet(vault_dir)
        )
        drain(streams.file_writer(joined, out, str(tmp_path / "ck")))
        rows = spark.read.schema(joined.schema).parquet(out).collect()
        return sorted((r.masked_id, r.matched) for r in rows)

    scores((first, 0.2, "m", "2026-01-20 12:00:00"), ("MASK-UNKNOWN", 0.9, "m", "2026-01-20 12:00:00"),
           (second, 0.5, "m", "2026-01-22 12:00:00"))
    assert step() == [(first, True)]
    # later events on both sides move the watermark: the unknown and the expired id come out
    later = vault.vault_rows(make({"transaction_id": "z"}), ring, config, F.lit("2026-01-30 00:00:00"))
    later.write.mode("append").parquet(vault_dir)
    scores(("MASK-LATER", 0.1, "m", "2026-01-30 00:00:00"))
    step()
    rows = step()
    assert (first, True) in rows and ("MASK-UNKNOWN", False) in rows and (second, False) in rows


def test_replayed_rows_give_one_result(spark, make, ring, config, tmp_path):
    stored = vault.vault_rows(make(), ring, config, F.lit("2026-01-20 10:00:00"))
    again = vault.vault_rows(make(), ring, config, F.lit("2026-01-20 10:05:00"))
    score = stored.select(
        "masked_id", F.lit(0.2).alias("fraud_probability"), F.lit("m").alias("model_version"),
        F.lit("2026-01-20 10:06:00").cast("timestamp").alias("predicted_at"),
    )
    other = score.withColumn("model_version", F.lit("other"))
    vault_dir, score_dir, out = (str(tmp_path / n) for n in ("vault", "scores", "out"))
    for turn in (1, 2):
        (stored if turn == 1 else stored.unionAll(again)).write.mode("append").parquet(vault_dir)
        score.unionAll(score).unionAll(other).write.mode("append").parquet(score_dir)
        joined = streams.restore_stream(
            spark.readStream.schema(score.schema).parquet(score_dir),
            spark.readStream.schema(stored.schema).parquet(vault_dir), how="inner",
        )
        drain(streams.file_writer(joined, out, str(tmp_path / "ck")))
        rows = spark.read.schema(joined.schema).parquet(out).collect()
        assert sorted(r.model_version for r in rows) == ["m", "other"]


def test_guarded_stream_is_idempotent(spark, make, ring, config, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    plain = make({}, {"transaction_id": "b"})
    masked = masking.mask_transactions(plain, ring, config).withColumn(
        "email", F.when(F.col("transaction_id") == "b", "plain@x.com").otherwise(F.col("email"))
    )
    masked = schemas.with_schema_classes(masked, schemas.MASKED_TRANSACTION)
    masked.write.parquet(source)
    for checkpoint in ("ck1", "ck2"):  # the second run replays batch 0
        stream = spark.readStream.schema(masked.schema).parquet(source)
        drain(streams.guarded_writer(stream, "cloud", out, str(tmp_path / "held"), str(tmp_path / checkpoint)))
    assert [r.transaction_id for r in spark.read.parquet(out).collect()] == ["TXN-20270308-000417"]
    assert [r.transaction_id for r in spark.read.parquet(str(tmp_path / "held")).collect()] == ["b"]
