"""Quality by importance resampling.

Two generative models of hashed n-grams are counted, one of target texts (labelled good) and one of all texts. A text's
importance is the ratio of the probabilities that the two give a passage of fixed length with the text's mixture of
n-grams: over whole texts the ratio would tell long from short rather than good from bad. Adding Gumbel noise to the
logarithms and taking the k largest samples k texts without replacement in proportion to their importance. The border that
the k-th key makes is fitted on labelled texts of both kinds.

The n-grams are runs of three bytes, which see symbols, case and letters of a language, and pairs of word shapes, which see
repetition and layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilspark.llm import text_bytes as tb
from veilspark.llm.tables import fresh, whole, written

RESULTS = ["log_weight", "sampling_key", "kept"]

#: Buckets of byte trigrams and of word shape pairs.
BYTE_BITS, SHAPE_BITS = 15, 12

#: Labelled rows used at most: half of the good ones count the target model, all others choose the border.
LABELLED_ROWS = 40_000

#: How many bad texts kept weigh as much as one good text lost.
LOSS = 20.0

#: N-grams of the passage that is weighed, and n-grams of no weight that each text is given beforehand.
PASSAGE, PRIOR = 256.0, 64.0

#: Occurrences of each bucket that both models are given beforehand.
SMOOTHING = 32.0

_SIZE = (1 << BYTE_BITS) + (1 << SHAPE_BITS)
_SPREAD = np.uint32(0x9E3779B1)

_CLASSES = np.full(256, 7, np.uint8)  # other symbols
_CLASSES[0x80:] = 0
_CLASSES[0x61:0x7B], _CLASSES[0x41:0x5B], _CLASSES[0x30:0x3A] = 0, 1, 2
_CLASSES[[ord(c) for c in ".,;:"]], _CLASSES[[ord(c) for c in "!?"]] = 3, 4
_CLASSES[[ord(c) for c in "\"'()-"]], _CLASSES[[ord(c) for c in "<>{}[]=/\\|"]] = 5, 6


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of n-grams in the order of the texts, and how many each text has; first of bytes, then of shapes."""
    sizes = np.diff(offsets)
    wide = data.astype(np.uint32)
    grams = np.zeros(0, np.uint32)
    if len(wide) > 2:
        grams = (wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * _SPREAD >> np.uint32(32 - BYTE_BITS)
    inside = np.ones(len(grams), bool)
    for back in (1, 2):
        edge = offsets[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(grams))]] = False
    yield grams[inside], np.maximum(sizes - 2, 0)

    words = tb.Words(data, offsets, tb.NOT_SPACE)
    first, last = _CLASSES[data[words.starts]].astype(np.uint32), _CLASSES[data[words.ends - 1]].astype(np.uint32)
    long = np.minimum((words.ends - words.starts) >> 3, 3).astype(np.uint32)
    again = np.zeros(len(first), np.uint32)
    texts = words.texts()
    for back in (1, 2, 3):
        again[back:] |= (words.hashes[back:] == words.hashes[:-back]) & (texts[back:] == texts[:-back])
    shape = first | last << np.uint32(3) | long << np.uint32(6) | again << np.uint32(8)
    before = np.concatenate([shape[:1] * 0, shape[:-1]]) + np.uint32(1)
    before[words.first[:-1][words.counts > 0]] = 0
    pairs = (shape + before * np.uint32(0x3FF)) * _SPREAD >> np.uint32(32 - SHAPE_BITS)
    yield pairs + np.uint32(1 << BYTE_BITS), words.counts


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket in all texts and in target texts of a partition."""
    counts = np.zeros((2, _SIZE), np.int64)
    for batch in batches:
        data, offsets = tb.flat(batch.column(0))
        target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in tb.blocks(offsets):
            for buckets, sizes in _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                counts[0] += np.bincount(buckets, minlength=_SIZE)
                counts[1] += np.bincount(buckets[np.repeat(target[i:j], sizes)], minlength=_SIZE)
    used = np.flatnonzero(counts[0])
    columns = [pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "raw", "target"])


def _weighing(ratios: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    def weigh(text: pa.Array) -> pa.Array:
        data, offsets = tb.flat(text)
        out, grams = [np.zeros(0)], [np.zeros(0, np.int64)]
        for i, j in tb.blocks(offsets):
            total, count = np.zeros(j - i), np.zeros(j - i, np.int64)
            for buckets, sizes in _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                sums = np.concatenate([[0.0], np.cumsum(ratios[buckets])])
                ends = np.cumsum(sizes)
                total += sums[ends] - sums[ends - sizes]
                count += sizes
            out.append(total)
            grams.append(count)
        columns = [pa.array(np.concatenate(out)), pa.array(np.concatenate(grams))]
        return pa.StructArray.from_arrays(columns, ["total", "grams"])

    return weigh


@dataclass(frozen=True)
class QualityModel:
    """Logarithms of the ratio of target to raw probability by bucket, and the smallest sampling key of a text to keep."""

    ratios: np.ndarray
    threshold: float
    seed: int

    def weighed(self, df: DataFrame, text_col: str, id_col: str, weight: str, key: str) -> DataFrame:
        uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), f"`{id_col}`"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        sums = fresh("sums", df)
        df = df.withColumn(sums, F.arrow_udf(_weighing(self.ratios), "struct<total:double,grams:bigint>")(whole(f"`{text_col}`")))
        passage = F.col(sums)["total"] * PASSAGE / (F.col(sums)["grams"] + PRIOR)
        return df.withColumn(weight, F.col(sums)["total"]).withColumn(key, passage - F.log(-F.log(uniform))).drop(sums)


def border(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The key from which texts are kept, from the keys of labelled good and bad texts.

    It makes the good texts below it, `loss` times, and the bad ones above it the fewest; among equals the lowest does. It lies
    halfway to the next bad key below. Where no bad key lies below, or no good one is known, nothing is rejected.
    """
    good, bad = np.sort(good), np.sort(bad)
    if not len(good):
        return float("-inf")
    places = np.unique(good)
    below = np.searchsorted(bad, places)
    best = int(np.argmin(loss * np.searchsorted(good, places) - below))
    return float((places[best] + bad[below[best] - 1]) / 2) if below[best] else float("-inf")


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
    loss: float = LOSS,
    seed: int = 1,
) -> QualityModel:
    """Counts both models and the `border` of the sampling keys.

    The raw model counts every text. Of at most `labelled_rows` labelled texts, taken by a hash of their identifier, the target
    model counts half of the good ones; the border is fitted on the other half and on the bad ones. Without good or without
    bad labels all texts are kept. Rows of `labels` with a null are passed over; a document labelled twice is good if it was
    once.
    """
    known = labels.where(f"`{label_col}` is not null and `{id_col}` is not null").groupBy(F.col(f"`{id_col}`").alias("id"))
    known = known.agg(F.max(F.col(f"`{label_col}`") == 1).alias("good"))
    order = F.xxhash64(F.lit(seed), F.lit("labelled"), "id")
    fitting = F.col("good") & (F.pmod(order, F.lit(2)) == 0)
    known = known.orderBy(order, "id").limit(labelled_rows).withColumn("fitting", fitting)
    known = written(known, "labelled")  # at most labelled_rows rows: small enough to send
    rows = df.select(F.col(f"`{id_col}`").alias("id"), whole(f"`{text_col}`").alias("text"))
    marked = rows.join(F.broadcast(known.where("fitting")), "id", "left")
    flags = marked.select("text", F.coalesce("fitting", F.lit(False)).alias("target"))
    counts = flags.mapInArrow(_counting, "bucket bigint, raw bigint, target bigint")
    raw, target = np.zeros(_SIZE), np.zeros(_SIZE)
    for bucket, all_, some in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket], target[bucket] = all_, some
    ratios = np.zeros(_SIZE)
    for part in (slice(0, 1 << BYTE_BITS), slice(1 << BYTE_BITS, _SIZE)):
        if target[part].sum():
            # What target texts would hold of a bucket if they were like all texts, against what they hold. Both take
            # SMOOTHING more, so that buckets too rare to tell weigh nothing.
            expected = raw[part] / raw[part].sum() * target[part].sum()
            ratios[part] = np.log((target[part] + SMOOTHING) / (expected + SMOOTHING))
    model = QualityModel(ratios, float("-inf"), seed)
    checked = rows.join(F.broadcast(known.where("not fitting")), "id")
    keys = model.weighed(checked, "text", "id", "w", "k").select("good", "k").collect()
    if not target.sum():
        return model
    good, bad = (np.array([k for is_good, k in keys if is_good == kind]) for kind in (True, False))
    return QualityModel(ratios, border(good, bad, loss), seed)


def importance_sample(
    df: DataFrame, model: QualityModel, k: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The input with `log_weight`, `sampling_key` and `kept`, true for the k texts with the largest keys.

    `log_weight` is that of the whole text, the key takes its share for one passage. Without `k`, it is the number of texts whose key reaches the model's threshold. Equal keys at the border are all kept.
    Null and empty texts weigh nothing (0). Input columns with the name of a result are replaced.
    """
    weight, key = fresh("weight", df), fresh("key", df)
    weighed = model.weighed(df, text_col, id_col, weight, key)
    border = model.threshold if k is None else kth_largest(weighed.select(F.col(key).alias("key")), k)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in RESULTS]
    results = [F.col(weight).alias(RESULTS[0]), F.col(key).alias(RESULTS[1]), (F.col(key) >= F.lit(border)).alias(RESULTS[2])]
    return weighed.select(*kept, *results)


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column `key` of doubles, by counting in ever narrower ranges; minus infinity if there are fewer."""
    keys = written(keys, "keys")
    total, low, high = keys.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if k >= total:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while low < high:
        width = (high - low) / bins
        if low + width <= low:
            return low
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        inside = keys.where(F.col("key").between(low, high)).groupBy(place.alias("bin"))
        found = inside.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for _, n, least, most in found.orderBy(F.desc("bin")).collect():
            if above + n >= k:
                low, high = least, most
                break
            above += n
    return low


def good_documents(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters
) -> DataFrame:
    """The rows that the sample keeps, with the columns of the input."""
    model = fit(df, labels, id_col, text_col, **parameters)
    weight, key = fresh("weight", df), fresh("key", df)
    weighed = model.weighed(df, text_col, id_col, weight, key)
    return weighed.where(F.col(key) >= F.lit(model.threshold)).drop(weight, key)
