"""Token files against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")

from veilspark.llm import token_files as tf  # noqa: E402

JSON = "byte_bpe_50k.json"
ODD = [
    None, "", " ", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>", "!" * 900, " " * 900 + "x", "a\n b", "a \nb",
    "a\n \nb", " a", "a ", "a\n\n b  c", "it's 's' !abc", "\x1c\x1d x", "日本語テキスト" * 30, "🙂👩‍👩‍👧" * 9, "IT'S ’s", "\x00\x01", "՘ ₏",
    "\U0003fffe x \U0003fffe", "x\xa0y  z", "!abc", "1a b2", "ab" * 20_000,
]


def library(texts, name=JSON):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [x.ids for x in found]


def mixed(count):
    rng = random.Random(9)
    return ["".join(rng.choice("ab  \n\t'sétÀ9!🙂½²́") for _ in range(rng.randint(0, 90))) for _ in range(count)]


@pytest.mark.parametrize("name", [JSON, "word_bpe_49k.json"])
@pytest.mark.parametrize("remembered", [tf.REMEMBERED, 50])
def test_ids_are_the_librarys(monkeypatch, name, remembered):
    monkeypatch.setattr(tf, "REMEMBERED", remembered)
    texts = [t or "" for t in ODD] + mixed(200) + ["the same row", "plain words only, the same row"] * 3
    encoder, got = tf.TextEncoder(public_tokenizers.path(name)), []
    for i in range(0, len(texts), 40):
        ids, counts = encoder.encode(texts[i : i + 40])
        got += [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == library(texts, name)


def test_files(spark, tmp_path):
    texts = ODD + mixed(300)
    random.Random(1).shuffle(texts)
    keys = [None, None, *range(2, 100), *[100] * 40, *range(140, len(texts))]
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in zip(keys, texts)], "doc_id long, text string, ids int, part string")
    tf.write_tokens(df.repartition(7), path, public_tokenizers.path(JSON), end_id=2)
    rows = tf.read_tokens(spark, path).withColumn("crc", tf.ids_crc32("ids")).orderBy("start").collect()
    ids = {i: [*x, 2] for i, x in enumerate(library(texts))}
    assert [r.doc_id for r in rows] == keys  # ascending, repeated and null ones too
    assert sorted(r.ids for r in rows if r.doc_id in (None, 100)) == sorted(x for i, x in ids.items() if keys[i] in (None, 100))
    at = 0
    for i, r in enumerate(rows):
        if r.doc_id not in (None, 100):
            assert r.ids == ids[i]
        assert (r.start, r.n_tokens, r.crc) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    assert {r.doc_id: r.ids for r in tf.tokens_of(spark, path, [7, 250, 10**6]).collect()} == {7: ids[7], 250: ids[250]}


def test_bloom_filters_skip_absent_documents(spark, tmp_path):
    path = str(tmp_path / "tokens")
    df = spark.range(0, 8000, 2).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    tf.write_tokens(df, path, public_tokenizers.path(JSON), end_id=2)

    def scanned(ids):
        found = tf.tokens_of(spark, path, ids)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().apply(0)
        return scan.metrics().apply("numOutputRows").value()

    assert scanned([4000]) < 4000
    assert sum(scanned([odd]) for odd in range(2001, 2021, 2)) < 10 * scanned([4000])  # in the range of ids, not in the filter
    assert scanned([10**7]) == 0


def test_text_identifiers_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([("b", "two words"), ("a", None)], "name string, body string")
    path = str(tmp_path / "tokens")
    tf.write_tokens(df, path, public_tokenizers.path(JSON), 2, "name", "body")
    rows = tf.read_tokens(spark, path, T.StringType()).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [("a", 0, 1), ("b", 1, len(library(["two words"])[0]) + 1)]
    tf.write_tokens(df.limit(0), path + "-none", public_tokenizers.path(JSON), 2, "name", "body")
    assert tf.read_tokens(spark, path + "-none", T.StringType()).count() == 0
