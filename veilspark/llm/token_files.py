"""Token ids of a corpus in ORC files, in the order of the identifiers.

Ids are lists of integers, which ORC stores run-length encoded in stripes. Each stripe has an index of its rows with the least and
greatest identifier of every few hundred rows, and a Bloom filter of the identifiers, so that a reader of a few documents skips
stripes and row groups by their metadata, and many readers share a file by its stripes.

Files come from a range partitioning by identifier: file after file, row after row is ascending order. A row holds its place among
the ids of its file; the ids of earlier files are added on reading, from one total for each file.

Texts are encoded piece by piece with the model of the tokenizers library, each distinct piece once while remembered. Where the pieces
of a text cannot be told without the library (unassigned characters, other kinds of vocabularies), the library takes the whole text.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from veilspark.llm.pieces import splitter
from veilspark.llm.tables import whole

#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies. Its alternatives begin with different characters, so their
#: order is free; the most frequent come first.
PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters and ids of remembered pieces, after which a worker starts anew.
REMEMBERED = 36_000_000

#: Characters of text encoded at a time; a longer text is taken alone.
BLOCK = 2_000_000

STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01

def _letter_table() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Places(dict):
    """Where the ids of a part of a text are kept, found out when first asked for."""

    def __init__(self, find: Callable[[str], int]):
        super().__init__()
        self._find = find

    def __missing__(self, key: str) -> int:
        self[key] = place = self._find(key)
        return place


#: Places of parts that cannot be encoded alone: white space beside a space, and characters unknown to Python's tables.
_SPACED, _UNKNOWN = -1, -2


class TextEncoder:
    """Ids of texts by a vocabulary file of the tokenizers library, without added tokens at the ends, padding or truncation.

    A text is cut at its spaces. What stands between two of them is encoded alike wherever it occurs, unless other white space
    touches a space; such texts are cut into the pieces of the pattern.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        model, before, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self._by_pieces = (
            model["type"] == "BPE" and not model.get("dropout") and not spec["normalizer"] and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        )
        self._marks = sorted((t["content"] for t in added), key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, self._marks))) if added else None
        self._split, self._letters, self._tokenize = splitter(PATTERN), _letter_table(), self._library.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self._places = _Places(self._place)
        self._pieces: dict[str, int] = {}
        self._ids, self._ends, self._held = array("i"), array("q", [0]), 0

    def _whole(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def _add(self, key: str, ids: list[int]) -> int:
        self._ids.extend(ids)
        self._ends.append(len(self._ids))
        self._held += len(key) + len(ids) + 8
        return len(self._ends) - 2

    def _place(self, key: str) -> int:
        """The place of a new part. A key is a part that follows a space, the first part of a text behind a space, or a piece
        with a space behind it."""
        if len(key) > 1 and key[-1] == " ":
            text = key[:-1]
            if text in self._marks:
                return self._add(key, self._whole(text))
        elif key[:1] == " ":
            text = key[1:]
            if text[-1:].isspace():
                return _SPACED
        else:
            text = f" {key}"
            if not key or key[0].isspace() or key[-1].isspace():
                return _SPACED
        if (text if key[:1] == " " else key).isalpha():
            return self._added_piece(key, text)
        places = [self._places[p[1:]] if p[0] == " " and p[1:].isalpha() else self._piece_place(p) for p in self._split(text)]
        if len(places) == 1 or _UNKNOWN in places:
            return min(places)
        return self._add(key, [i for p in places for i in self._ids[self._ends[p] : self._ends[p + 1]]])

    def _piece_place(self, piece: str) -> int:
        place = self._pieces.get(piece)
        if place is None:
            self._pieces[piece] = place = self._added_piece(piece, piece)
        return place

    def _added_piece(self, key: str, piece: str) -> int:
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", self._letters[0x20])
        elif piece.lstrip(" ").isalpha() or not any(unicodedata.category(c) == "Cn" for c in piece):
            letters = "".join(map(self._letters.__getitem__, piece.encode()))
        else:
            return _UNKNOWN
        return self._add(key, [t.id for t in self._tokenize(letters)])

    def _piece_keys(self, text: str) -> list[str]:
        out, at = [], 0
        for found in self._added.finditer(text) if self._added else ():
            out += [f"{piece} " for piece in self._split(text[at : found.start()])]
            out.append(f"{found[0]} ")
            at = found.end()
        return out + [f"{piece} " for piece in self._split(text[at:])]

    def _keys(self, text: str) -> list[str]:
        for mark in self._marks:
            if mark in text:
                return self._piece_keys(text)
        parts = text.split(" ")
        parts[0] = f" {parts[0]}"
        return parts

    def _gathered(self, places: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids kept at places, and how many there are up to each text's last place."""
        ends, ids = np.frombuffer(self._ends, np.int64), np.frombuffer(self._ids, np.int32)
        counts = ends[places + 1] - ends[places]
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        out = ids[np.repeat(ends[places] - after + counts, counts) + np.arange(total)] if total else np.zeros(0, np.int32)
        return out, np.diff(np.concatenate([[0], after])[np.concatenate([[0], last])])

    def _one(self, text: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = places.min(initial=0)
        if least == _SPACED:
            keys = self._piece_keys(text)
            places = np.array([self._places[k] for k in keys], np.int64)
            least = places.min(initial=0)
        if least == _UNKNOWN:
            ids = np.array(self._whole(text), np.int32)
            return ids, np.array([len(ids)], np.int64)
        return self._gathered(places, np.array([len(places)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if not self._by_pieces:
            every = [e.ids for e in self._library.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for ids in every for i in ids], np.int32), np.array([len(ids) for ids in every], np.int64)
        if self._held > REMEMBERED:
            self._forget()
        keys, sizes = [], []
        for text in texts:
            own = self._keys(text)
            keys += own
            sizes.append(len(own))
        places = np.fromiter(map(self._places.__getitem__, keys), np.int64, len(keys))
        last = np.cumsum(np.array(sizes, np.int64))
        if len(places) and places.min() < 0:
            parts = [self._one(t, places[b - n : b]) for t, n, b in zip(texts, sizes, last)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self._gathered(places, last)


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _encoding(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _blocks(texts):
                ids, counts = encoder.encode(texts[i:j])
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), end_id, np.int32)
                inner = np.ones(len(out), bool)
                inner[ends - 1] = False
                out[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))
                places = pa.array(first + ends - counts - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), places, pa.array(counts + 1), lists],
                    ["doc_id", "part", "first", "n_tokens", "ids"],
                )
                first += int(ends[-1])

    return encode


def _schema(kind: T.DataType) -> T.StructType:
    fields = [("doc_id", kind), ("part", T.IntegerType()), ("first", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(n, k) for n, k in fields])


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of each text, with `end_id` behind them, to ORC files under `path`, in ascending order of the identifier.

    Null texts count as empty and have the end id alone. Null identifiers come first; rows with the same identifier follow each other in
    the order of a hash of their texts, so an identifier of very many rows is dealt to several files. Other columns are not read. An
    empty table gives files without rows. The vocabulary file must be readable on every executor.
    """
    text = whole(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    coded = ordered.mapInArrow(_encoding(vocabulary, end_id), _schema(rows.schema["id"].dataType))
    options = {
        "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES,
    }
    coded.write.options(**options).orc(path)


def _files(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    return spark.read.schema(_schema(kind)).orc(path)


def read_tokens(spark: SparkSession, path: str, kind: T.DataType = T.LongType()) -> DataFrame:
    """`doc_id`, `start` (how many ids come before the document's), `n_tokens` and `ids`, read from the files.

    `kind` is the identifier's type. A filter on doc_id is answered by the stripes' metadata where these rule it out.
    """
    files = _files(spark, path, kind)
    # One total for each file, so the table has as many rows as there were tasks that wrote.
    totals = files.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    earlier = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(earlier, F.lit(0)).alias("base"))
    rows = files.join(F.broadcast(bases), "part")
    return rows.select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.size("ids").cast("bigint").alias("n_tokens"), "ids")


def tokens_of(spark: SparkSession, path: str, ids: list, kind: T.DataType = T.LongType()) -> DataFrame:
    """`doc_id` and `ids` of some documents. Stripes and row groups whose range or Bloom filter rules them out are not read."""
    return _files(spark, path, kind).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def _checksums(ids: pa.Array) -> pa.Array:
    at = ids.offsets.to_numpy()
    data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64())


def ids_crc32(ids: str | Column) -> Column:
    """The unsigned CRC-32 of ids as unsigned little-endian 32-bit integers."""
    return F.arrow_udf(_checksums, "bigint")(ids)
