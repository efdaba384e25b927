"""The quality classifier against a plain version, and its border."""

import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from veilspark.llm import quality  # noqa: E402

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def kind(byte):
    c = chr(byte)
    if c.islower() and c.isascii() or byte >= 0x80:
        return 0
    for n, group in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "\"'()-", "<>{}[]=/\\|"), 1):
        if c in group:
            return n
    return 7


def buckets(text):
    """Trigram and shape buckets of one text, one at a time."""
    data = (text or "").encode()
    spread = 0x9E3779B1
    out = [((data[k] | data[k + 1] << 8 | data[k + 2] << 16) * spread & 0xFFFFFFFF) >> 17 for k in range(len(data) - 2)]
    words, before = re.findall(rb"[^\x20\x09-\x0D]+", data), 0
    lowered = [w.lower() for w in words]
    for n, word in enumerate(words):
        again = lowered[n] in lowered[max(0, n - 3) : n]
        shape = kind(word[0]) | kind(word[-1]) << 3 | min(len(word) // 8, 3) << 6 | again << 8
        out.append((1 << 15) + (((shape + before * 0x3FF) * spread & 0xFFFFFFFF) >> 20))
        before = shape + 1
    return out


def test_weights_against_counts_of_one_text_after_the_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-3, "a"), (-4, "x x y x " * 3000)], docs.schema)).cache()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    order = F.pmod(F.xxhash64(F.lit(1), F.lit("labelled"), "doc_id"), F.lit(2)) == 0
    rows = [(r.doc_id, buckets(r.text), r.doc_id in good and r.fitting) for r in docs.withColumn("fitting", order).collect()]
    raw, target = np.zeros(quality._SIZE), np.zeros(quality._SIZE)
    for _, found, fitting in rows:
        for b in found:
            raw[b] += 1
            target[b] += fitting
    ratios = np.zeros(quality._SIZE)
    for b in range(quality._SIZE):
        part = slice(0, 1 << 15) if b < 1 << 15 else slice(1 << 15, None)
        expected = raw[b] / raw[part].sum() * target[part].sum()
        ratios[b] = np.log((target[b] + quality.SMOOTHING) / (expected + quality.SMOOTHING))
    model = quality.fit(docs, labels)
    assert model.ratios == pytest.approx(ratios)
    got = sorted((r.doc_id, r.log_weight) for r in quality.importance_sample(docs, model).collect())
    want = sorted((i, sum(ratios[b] for b in found)) for i, found, _ in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [w for _, w in got] == pytest.approx([w for _, w in want], abs=1e-6)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"same word", b"word same word", b"", b"other same", b"a"]
    offsets = np.cumsum([0, *map(len, texts)])
    together = [(b.tolist(), n.tolist()) for b, n in quality._features(np.frombuffer(b"".join(texts), np.uint8), offsets)]
    alone = [list(quality._features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) for t in texts]
    for part, (found, sizes) in enumerate(together):
        assert found == [int(b) for one in alone for b in one[part][0]]
        assert sizes == [int(one[part][1][0]) for one in alone]


def test_border():
    none = np.zeros(0)
    assert quality.border(none, none) == quality.border(none, np.ones(3)) == quality.border(np.ones(3), none) == -np.inf
    assert quality.border(np.array([5.0, 9.0]), np.array([1.0, 3.0])) == 4.0
    assert quality.border(np.array([5.0, 9.0]), np.array([6.0, 7.0])) == -np.inf  # losing one good text costs more
    assert quality.border(np.array([0.0, 5.0]), np.full(21, 2.0)) == 3.5  # 21 bad ones weigh more than a good one
    assert quality.border(np.array([0.0, 5.0]), np.full(20, 2.0)) == -np.inf
    assert quality.border(np.array([4.0, 4.0]), np.array([4.0, 2.0])) == 3.0  # ties are kept


def test_both_classes_on_held_out_rows(spark):
    """Good rows that counted no model are kept, and most bad ones go."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.importance_sample(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    held_out = rows.where("quality = 0 or pmod(xxhash64(1, 'labelled', doc_id), 2) = 1")
    kept = {r.quality: r.kept for r in held_out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] >= 0.99 and kept[0] <= 0.15
