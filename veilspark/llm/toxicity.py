"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and six bytes, so that inflected forms share
most of it. Filters of several widths slide over the words, the largest response of each filter over the whole text goes to a
logistic output. Scores never see the language; only the thresholds of the operator's own decision are calibrated by
it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.llm import text_bytes as tb
from veilspark.llm.tables import fresh, whole, with_results, written

#: Buckets of embeddings, size of a word's vector, filters of each width.
BUCKET_BITS, VECTOR, FILTERS, WIDTHS = 16, 12, 8, (1, 2, 3)

#: Labelled rows of each label used at most.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 5_000

#: Passes over the training texts, and steps at least.
EPOCHS, STEPS = 5, 400

#: One labelled row in so many calibrates instead of training.
CALIBRATING = 5

_PAD = 1 << BUCKET_BITS
_PARTS = (1 << 30, 4, 6)


def _word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word, and the words of each text."""
    words = tb.Words(data, offsets, tb.ALPHANUMERIC)
    ranges = tb.RangeHash(words.lowered)
    ids = [ranges(words.starts, np.minimum(words.ends, words.starts + size)) >> np.uint64(64 - BUCKET_BITS) for size in _PARTS]
    return np.stack(ids, 1).astype(np.int32), words.counts


def _ids_column(text: pa.Array) -> pa.Array:
    data, offsets = tb.flat(text)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for i, j in tb.blocks(offsets):
        some, many = _word_ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ids.append(some.reshape(-1))
        counts.append(many * len(_PARTS))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(ids)))


def _padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with room for the widest filter after each text, and where each text starts (and the last one ends)."""
    room = max(WIDTHS)
    starts = np.concatenate([[0], np.cumsum(counts + room)])
    out = np.full((starts[-1], len(_PARTS)), _PAD, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * room, counts)] = ids
    return out, starts


@dataclass
class ToxicityModel:
    """Weights, and the smallest score that counts as toxic by language; `None` stands for every other language."""

    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    offset: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})

    @classmethod
    def new(cls, seed: int) -> ToxicityModel:
        random = np.random.default_rng(seed)
        embeddings = random.normal(0, 0.02, (_PAD + 1, VECTOR)).astype(np.float32)
        embeddings[_PAD] = 0
        filters = [random.normal(0, 0.5 / w**0.5, (w * VECTOR, FILTERS)).astype(np.float32) for w in WIDTHS]
        biases = [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS]
        output = random.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        return cls(embeddings, filters, biases, output)

    def vectors(self, words: np.ndarray) -> np.ndarray:
        return sum(self.embeddings[words[:, p]] for p in range(len(_PARTS)))

    def responses(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """Each width's filters at each word."""
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases):
            size = len(vectors) - width + 1
            total = vectors[:size] @ weights[:VECTOR] + bias
            for j in range(1, width):
                total += vectors[j : j + size] @ weights[j * VECTOR : (j + 1) * VECTOR]
            yield total

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        words, starts = _padded(ids, counts)
        pooled = []
        for width, response in zip(WIDTHS, self.responses(self.vectors(words))):
            # from each text's start to where the filter would reach into the next
            bounds = np.stack([starts[:-1], starts[1:] - width + 1], 1).reshape(-1)[:-1]
            pooled.append(np.maximum(np.maximum.reduceat(response, bounds)[::2], 0))
        return 1 / (1 + np.exp(-(np.concatenate(pooled, 1) @ self.output + self.offset).astype(np.float64)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int, batch: int = 32, rate: float = 0.1) -> None:
        random = np.random.default_rng(seed)
        weights = [self.embeddings, *self.filters, *self.biases, self.output]
        sums = [np.full_like(w, 1e-3) for w in weights]
        offset_sum = 1e-3
        for _ in range(max(epochs, STEPS * batch // len(texts))):
            order = random.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                rows, gradients, offset = self._gradients([texts[i] for i in some], labels[some])
                for n, gradient in enumerate(gradients):
                    part = rows if n == 0 else slice(None)
                    sums[n][part] += gradient**2
                    weights[n][part] -= rate * gradient / np.sqrt(sums[n][part])
                offset_sum += offset**2
                self.offset -= rate * offset / offset_sum**0.5

    def _gradients(self, texts: list[np.ndarray], labels: np.ndarray):
        words, starts = _padded(np.concatenate(texts), np.array([len(t) for t in texts]))
        vectors = self.vectors(words)
        pooled, places = [], []
        for response, width in zip(self.responses(vectors), WIDTHS):
            place = np.stack([s + response[s:e].argmax(0) for s, e in zip(starts[:-1], starts[1:] - width + 1)])
            pooled.append(np.take_along_axis(response, place, 0))
            places.append(place)
        top = np.maximum(np.concatenate(pooled, 1), 0)
        scores = 1 / (1 + np.exp(-np.clip(top @ self.output + self.offset, -30, 30)))
        error = ((scores - labels) / len(labels)).astype(np.float32)
        filters, biases, at, values = [], [], [], []
        for n, (width, place) in enumerate(zip(WIDTHS, places)):
            own = slice(n * FILTERS, (n + 1) * FILTERS)
            slope = error[:, None] * self.output[own] * (pooled[n] > 0)
            around = place[:, :, None] + np.arange(width)
            seen = vectors[around]
            filters.append(np.einsum("bf,bfwd->wdf", slope, seen).reshape(width * VECTOR, FILTERS))
            biases.append(slope.sum(0))
            back = np.einsum("bf,wdf->bfwd", slope, self.filters[n].reshape(width, VECTOR, FILTERS))
            at.append(words[around.reshape(-1)])
            values.append(back.reshape(-1, VECTOR))
        used = np.concatenate(at)
        rows, place = np.unique(used, return_inverse=True)
        change = np.zeros((len(rows), VECTOR), np.float32)
        place = place.reshape(used.shape)
        for p in range(len(_PARTS)):
            np.add.at(change, place[:, p], np.concatenate(values))
        change[rows == _PAD] = 0
        return rows, [change, *filters, *biases, top.T @ error], float(error.sum())


def _calibrated(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1, in the middle between the scores it lies between."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    best = int(f1.argmax())
    after = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((scores[order[best]] + after) / 2)


def held_out(id_col: str | Column) -> Column:
    """Rows that no training may see: by a checksum of the identifier as text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lang_col: str | None = "lang",
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
    epochs: int = EPOCHS,
    seed: int = 1,
) -> ToxicityModel:
    """A model of labelled rows that are not held out: at most `toxic_rows` and `clean_rows` of them, taken by a hash of
    the identifier, whole texts. One in `CALIBRATING` sets the thresholds. A document labelled twice is toxic if it was once; rows of
    `labels` with a null are passed over. With one label only or none, every score is that of the share of toxic labels.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    toxic, total = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    order = F.xxhash64(F.lit(seed), "id")
    parts = [known.where(F.col("label") == n).orderBy(order, "id").limit(k) for n, k in ((1, toxic_rows), (0, clean_rows))]
    chosen = written(parts[0].unionAll(parts[1]), "labelled")  # at most toxic_rows + clean_rows rows: small enough to send
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), lang.alias("lang"), whole(f"`{text_col}`").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("id", "lang", "label", F.arrow_udf(_ids_column, "array<int>")("text").alias("ids"))
    table = rows.toArrow().sort_by([("id", "ascending")])

    model = ToxicityModel.new(seed)
    truth = table["label"].to_numpy().astype(np.float32)
    rate = (toxic + 0.5) / (total + 1)
    if not len(truth) or truth.min() == truth.max():
        model.output[:] = 0
        model.offset = float(np.log(rate / (1 - rate)))
        return model
    lists = table["ids"].combine_chunks()
    flat, ends = lists.flatten().to_numpy().reshape(-1, len(_PARTS)), lists.offsets.to_numpy() // len(_PARTS)
    ends = ends - ends[0]
    texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    calibrating = np.arange(len(texts)) % CALIBRATING == CALIBRATING - 1
    fitting = np.flatnonzero(~calibrating)
    model.train([texts[i] for i in fitting], truth[fitting], epochs, seed)
    # The sample has more toxic texts than the labels: bring the offset back to their share.
    share = truth[fitting].mean()
    model.offset += float(np.log(rate / (1 - rate)) - np.log(share / (1 - share)))

    check = np.flatnonzero(calibrating)
    if len(check) and 0 < truth[check].sum() < len(check):
        scores = np.concatenate([model.scores(texts[i], np.array([len(texts[i])])) for i in check])
        langs = np.array([x or "" for x in table["lang"].to_pylist()], object)[check]
        model.thresholds = {None: _calibrated(scores, truth[check])}
        for lang in set(langs) - {""}:
            own = langs == lang
            if 0 < truth[check][own].sum() < own.sum():
                model.thresholds[lang] = _calibrated(scores[own], truth[check][own])
    return model


def _scoring(model: ToxicityModel) -> Callable[[pa.Array], pa.Array]:
    def score(text: pa.Array) -> pa.Array:
        data, offsets = tb.flat(text)
        out = [np.zeros(0)]
        for i, j in tb.blocks(offsets, tb.BLOCK_BYTES // 4):
            out.append(model.scores(*_word_ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
        return pa.array(np.concatenate(out))

    return score


def toxicity_scores(
    df: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str | None = "lang", results: tuple[str, str] = ("score", "toxic")
) -> DataFrame:
    """The input with the score of each whole text (0 to 1) and whether it reaches the threshold of its language.

    Empty and null texts get the score of no words; a null or unknown language takes the common threshold. Input
    columns with the name of a result are replaced.
    """
    score, toxic = results
    known = [(lang, t) for lang, t in model.thresholds.items() if lang is not None]
    threshold = F.lit(model.thresholds[None])
    if lang_col and known:
        for lang, t in known:
            threshold = F.when(F.col(f"`{lang_col}`") == lang, t).otherwise(threshold)
    out = F.arrow_udf(_scoring(model), "double")(whole(f"`{text_col}`"))
    limit = fresh("threshold", df)
    scored = with_results(df.withColumn(limit, threshold), F.struct(out.alias(score)), [score])
    return with_results(scored, F.struct((F.col(f"`{score}`") >= F.col(limit)).alias(toxic)), [toxic]).drop(limit)
