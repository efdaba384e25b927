"""The columns that the query of repeated passages derives."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from veilspark.llm import queries  # noqa: E402


def test_excerpts_and_copies(spark, tmp_path):
    rng = random.Random(8)

    def words(count):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(count))

    passage, copied = words(70), words(90)
    texts = [words(300) + passage + words(200), words(250) + passage, copied, copied, words(100), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_repeated_passages(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.shortened for r in rows] == [True, True, True, True, False, False, False]
    assert [r.excerpt for r in rows] == [True, True, False, False, False, False, False]
    assert [r.n_removed for r in rows[2:4]] == [len(copied)] * 2 and rows[0].n_removed >= len(passage)
