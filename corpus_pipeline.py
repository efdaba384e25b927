"""From raw documents to token ids: quality, exact and near duplicates, benchmark passages, encoding.

Each stage works on all that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.llm.byte_bpe import encode_and_decode
from veilspark.llm.decontamination import decontaminated
from veilspark.llm.exact_duplicates import drop_exact_duplicates
from veilspark.llm.near_duplicates import drop_near_duplicates
from veilspark.llm.quality import good_documents
from veilspark.llm.tables import small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs, any_names=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text; `intact` says whether they decode to its bytes."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_and_decode(docs, path, public_tokenizers.PATTERN)
    intact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES = [
    ("quality", quality),
    ("exact duplicates", exact),
    ("near duplicates", near),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Near duplicates by sketches, models and byte pairs have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
