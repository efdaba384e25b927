"""Collocations: phrases that occur far more often than their parts would meet by chance, by language.

Phrases are counted level by level. A phrase of k + 1 words is only a candidate if both phrases of k words in it are (the Apriori rule),
and if what the tasks have seen of it adds up to the least frequency.

1. The candidates of a level are packed into double-array tries, some ten thousand phrases each, built in tasks.
2. The tries go to all tasks if their phrases stay below a bound in bytes. All words of a block of text start in the root at once; each
   step moves all of them by one byte, and drops those without a child. The first word of a phrase is walked once for each distinct word.
3. Where two accepted phrases overlap in all but one word each, the task proposes their union for the next level. Every place of a
   frequent phrase is proposed, so the sums over all tasks are its counts, and no level is counted again.

Proposals travel as the numbers of their halves. Where a level's candidates exceed the bound, its phrases are told by a bit map of
bounded size and the numbers of their words from the tries of the first level; a proposal is the numbers of its words. Only where the
words themselves exceed the bound, or their numbers no longer fit one code, tasks propose every phrase of the next level. The results
are the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.llm import text_bytes as tb
from veilspark.llm.tables import partitions, written
from veilspark.operators.lookup import lookup_join

LEAST, LONGEST, TOP, PERCENT, SCALE = 10, 3, 2000, 50, 1_000_000

#: Bytes of the phrases whose tries may be sent to the tasks at a time, and phrases of one trie.
TRIE_BYTES, TRIE_PHRASES = 16_000_000, 40_000

#: Bits of the map that tells the phrases of a level without tries, and of one of its parts.
MAP_BITS, MAP_PART = 27, 16

#: Phrases that a task holds before it hands them on, and places of proposals.
HELD, HELD_PLACES = 200_000, 1_500_000

#: Longer phrases are looked up in a dictionary and not in the trie.
DEEPEST = 96

_BLOCK = 1_000_000
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORDS = ~_BREAKS
_WORDS[[0x20, 0x09]] = False
_WORD, _PIECE = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+"), re.compile(rb"[.,;:!?\x0A-\x0D]")
_COUNTS = "lang string, phrase binary, n bigint"
_NUMBERED = "code bigint, n bigint"


class Trie:
    """A double-array trie of distinct byte strings: from a state, byte b leads to base[state] + b if that cell's check is the state."""

    def __init__(self, phrases: list[bytes]):
        self.phrases = sorted(phrases)
        short = [i for i, p in enumerate(self.phrases) if len(p) <= DEEPEST]
        self.long = {p: i for i, p in enumerate(self.phrases) if len(p) > DEEPEST}
        parent, symbol, child, last = self._edges([self.phrases[i] for i in short])
        children = np.bincount(parent, minlength=int(child.max(initial=0)) + 1)
        base = self._placed(parent, symbol, children)
        cells = np.zeros(len(children), np.int64)
        cells[child] = base[parent] + symbol
        size = int(max(cells.max(initial=0), base.max(initial=0)) + 257)
        self.base, self.check, self.accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[cells] = base
        self.check[cells[child]] = cells[parent]
        self.accept[cells[last]] = short

    @staticmethod
    def _edges(phrases: list[bytes]) -> tuple[np.ndarray, ...]:
        """Parent, symbol and child of each edge, and each phrase's last node; nodes are numbered level by level, the root is 0."""
        sizes = np.array([len(p) for p in phrases], np.int64)
        letters = np.full((len(phrases), int(sizes.max(initial=0))), -1, np.int16)
        letters[np.arange(letters.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(phrases), np.uint8)
        node, last, known, parts = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64), 1, []
        for depth in range(letters.shape[1]):
            rows = np.flatnonzero(sizes > depth)
            above, own = node[rows], letters[rows, depth]
            new = np.ones(len(rows), bool)
            new[1:] = (above[1:] != above[:-1]) | (own[1:] != own[:-1])
            node[rows] = known - 1 + np.cumsum(new)
            parts.append((above[new], own[new].astype(np.int64), node[rows][new]))
            known += int(new.sum())
            ended = sizes == depth + 1
            last[ended] = node[ended]
        none = (np.zeros(0, np.int64),) * 3
        return *(np.concatenate(c) for c in zip(none, *parts)), last

    @staticmethod
    def _placed(parent: np.ndarray, symbol: np.ndarray, children: np.ndarray) -> np.ndarray:
        """A base for each node, so that no two nodes' children share a cell. Those with most children choose first; those with one
        child fill what is left."""
        first = np.searchsorted(parent, np.arange(len(children)))
        base = np.zeros(len(children), np.int64)
        free = np.ones(2 * len(children) + 8192, bool)
        free[0] = False
        low, window = 1, 2048
        for node in sorted(np.flatnonzero(children > 1).tolist(), key=lambda n: -children[n]):
            own = symbol[first[node] : first[node] + children[node]]
            while True:
                if low + window + 512 > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = free[low + own[0] : low + own[0] + window].copy()
                for s in own[1:]:
                    fits &= free[low + s : low + s + window]
                at = int(fits.argmax())
                if fits[at]:
                    break
                low += window
            base[node] = low + at
            free[base[node] + own] = False
        single = np.flatnonzero(children == 1)
        cells = np.flatnonzero(free)
        cells = cells[cells > 256]
        if len(cells) < len(single):
            cells = np.concatenate([cells, np.arange(len(free), len(free) + len(single))])
        base[single] = cells[: len(single)] - symbol[first[single]]
        return base

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each byte range its phrase's number, or -1."""
        return self._walked(data, starts, ends, starts, np.zeros(len(starts), np.int64))

    def match_phrases(self, block: _Block, first: np.ndarray, words: int) -> np.ndarray:
        """For the phrases of so many words at the words `first` their numbers, or -1."""
        heads = np.diff(block.own_starts)
        if words == 1:
            return self.match(block.own, block.own_starts[:-1], block.own_starts[1:] - 1)[block.own_word[first]]
        states = self._reached(block.own, block.own_starts)[block.own_word[first]]
        starts, ends = block.starts[first], block.starts[first + words] - 1
        return self._walked(block.data, starts, ends, starts + heads[block.own_word[first]], states)

    def _reached(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The state behind each of the texts of `data`, or -1."""
        out = np.full(len(offsets) - 1, -1, np.int64)
        active = np.flatnonzero(np.diff(offsets) <= DEEPEST)
        at, end, state = offsets[active], offsets[active + 1], np.zeros(len(active), np.int64)
        while len(active):
            following = self.base[state] + data[at].astype(np.int64)
            moved = self.check[following] == state
            active, at, end, state = active[moved], at[moved] + 1, end[moved], following[moved]
            done = at == end
            out[active[done]] = state[done]
            active, at, end, state = active[~done], at[~done], end[~done], state[~done]
        return out

    def _walked(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Numbers of the byte ranges, of which the part before `at` has led to `state`."""
        out = np.full(len(starts), -1, np.int64)
        if self.long:
            for i in np.flatnonzero(ends - starts > DEEPEST):
                out[i] = self.long.get(data[starts[i] : ends[i]].tobytes(), -1)
        active = np.flatnonzero((ends - starts <= DEEPEST) & (state >= 0))
        at, end, state = at[active], ends[active], state[active]
        while len(active):
            following = self.base[state] + data[at].astype(np.int64)
            moved = self.check[following] == state
            active, at, end, state = active[moved], at[moved] + 1, end[moved], following[moved]
            done = at == end
            out[active[done]] = self.accept[state[done]]
            going = ~done
            active, at, end, state = active[going], at[going], end[going], state[going]
        return out


class _Block:
    """Words of a block of texts, in lower case with one space behind each, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _WORDS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        starts, ends = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
        sizes = ends - starts
        self.data = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        letters = np.flatnonzero(inside)
        self.data[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = tb.LOWER[data[letters]]
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        pieces = np.cumsum(_BREAKS[data]) + np.cumsum(edge)[:-1]
        self.joined = pieces[starts[1:]] == pieces[starts[:-1]]
        # The distinct words, each with its space, and which of them stands at each place.
        buffers = [None, pa.py_buffer(self.starts.astype(np.int32)), pa.py_buffer(self.data)]
        coded = pa.Array.from_buffers(pa.binary(), len(sizes), buffers).dictionary_encode()
        self.own, self.own_starts = tb.flat(coded.dictionary)
        self.own_word = coded.indices.to_numpy(zero_copy_only=False)

    def phrases(self, words: int) -> np.ndarray:
        """First words of all phrases of so many words."""
        count = len(self.starts) - words
        fits = np.ones(max(0, count), bool)
        for j in range(words - 1):
            fits &= self.joined[j : j + count]
        return np.flatnonzero(fits)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column("lang")
    for lang in langs.unique().to_pylist():
        yield lang, batch.column("text").filter(pc.equal(langs, lang))


def _handed_on(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        columns = [pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def _proposing(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every phrase of so many words, with how often the task has seen it."""
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, texts in _by_lang(batch):
                own = counts.setdefault(lang, Counter())
                for text in texts.to_pylist():
                    if words == 1:
                        own.update(_WORD.findall(text.lower()))
                    else:
                        for piece in _PIECE.split(text.lower()):
                            found = _WORD.findall(piece)
                            own.update(map(b" ".join, zip(*(found[j:] for j in range(words)))))
                    if len(own) > HELD:
                        yield from _handed_on(counts)
                        own = Counter()
                        counts = {lang: own}
        yield from _handed_on(counts)

    return propose


def _numbered(langs: int, lang: int, numbers: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of a number and a count. One code holds number and language: numbers of proposals stay below the square of a language's
    candidates, which the bound on the tries keeps far below what a code can hold, or are known to fit."""
    code = numbers.astype(np.int64) * langs + lang
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])


class _Tries:
    """Tries by language, with their phrases numbered throughout the language."""

    def __init__(self, rows: list[tuple]):
        self.langs = sorted({lang for lang, *_ in rows})
        self.tries = {lang: [_unpacked(*row[1:]) for row in rows if row[0] == lang] for lang in self.langs}
        self.phrases = {lang: [p for t in own for p in t.phrases] for lang, own in self.tries.items()}

    def numbers(self, lang: str, block: _Block, words: int) -> np.ndarray:
        """For each word of a block the number of the phrase of so many words that starts there, or -1."""
        first = block.phrases(words)
        number, before = np.full(len(block.starts), -1, np.int64), 0
        for trie in self.tries[lang]:
            found = trie.match_phrases(block, first, words)
            number[first[found >= 0]] = found[found >= 0] + before
            before += len(trie.phrases)
        return number


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    """The place of each code in a bit map."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _advancing(words: int, sent: Callable[[], _Tries], told: Callable[[], np.ndarray] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Proposals of one word more than `words`, by the numbers of both halves; with a bit map of the phrases, by the numbers of the words."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits = sent(), told() if told else None
        index = {lang: i for i, lang in enumerate(own.langs)}
        places: list[list[np.ndarray]] = [[] for _ in index]
        held = 0

        def proposals() -> Iterator[pa.RecordBatch]:
            for i, found in enumerate(places):
                if found:
                    yield _numbered(len(places), i, *np.unique(np.concatenate(found), return_counts=True))
                    found.clear()

        def of_halves(lang: str, block: _Block) -> np.ndarray:
            number, longer = own.numbers(lang, block, words), block.phrases(words + 1)
            one, other = number[longer], number[longer + 1]
            both = (one >= 0) & (other >= 0)
            return one[both] * len(own.phrases[lang]) + other[both]

        def of_words(lang: str, block: _Block) -> np.ndarray:
            number, size = own.numbers(lang, block, 1), len(own.phrases[lang])
            longer = block.phrases(words + 1)
            for j in range(words + 1):
                longer = longer[number[longer + j] >= 0]

            def code(first: np.ndarray, count: int) -> np.ndarray:
                out = np.zeros(len(first), np.int64)
                for j in range(count):
                    out = out * size + number[first + j]
                return out

            for at in (0, 1):
                slots = _slots(code(longer + at, words) * len(places) + index[lang], MAP_BITS)
                longer = longer[bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 > 0]
            return code(longer, words + 1)

        for batch in batches:
            for lang, texts in _by_lang(batch):
                if lang not in index:
                    continue
                data, offsets = tb.flat(texts)
                for i, j in tb.blocks(offsets, _BLOCK):
                    block = _Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    places[index[lang]].append((of_halves if told is None else of_words)(lang, block))
                    held += len(places[index[lang]][-1])
                    if held > HELD_PLACES:
                        yield from proposals()
                        held = 0
        yield from proposals()

    return advance


def _naming(sent: Callable[[], _Tries], words: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases beside their codes: the first half and the last word of the second, or with `words` so many numbered words."""
        own = sent()
        for batch in batches:
            langs, phrases = [], []
            for code in batch.column("code").to_pylist():
                number, lang = divmod(code, len(own.langs))
                langs.append(own.langs[lang])
                known = own.phrases[own.langs[lang]]
                if words:
                    parts = []
                    for _ in range(words):
                        number, last = divmod(number, len(known))
                        parts.append(known[last])
                    phrases.append(b" ".join(reversed(parts)))
                else:
                    one, other = divmod(number, len(known))
                    phrases.append(b"%b %b" % (known[one], known[other].rpartition(b" ")[2]))
            columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), batch.column("n"), batch.column("code")]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "code"])

    return name


def _packed(table: pa.Table) -> pa.Table:
    """The trie of the phrases of one shard, as its arrays."""
    trie = Trie(table["phrase"].to_pylist())
    arrays = [np.ascontiguousarray(a).tobytes() for a in (trie.base, trie.check, trie.accept)]
    return pa.table({"lang": table["lang"].slice(0, 1), "phrases": pa.array([trie.phrases], pa.list_(pa.binary())), "arrays": pa.array([arrays], pa.list_(pa.binary()))})


def _unpacked(phrases: list[bytes], arrays: list[bytes]) -> Trie:
    trie = Trie.__new__(Trie)
    trie.phrases = phrases
    trie.base, trie.check, trie.accept = (np.frombuffer(a, np.int32) for a in arrays)
    trie.long = {p: i for i, p in enumerate(phrases) if len(p) > DEEPEST}
    return trie


def _sent(candidates: DataFrame, limit: int) -> tuple[Callable[[], _Tries], list[int]] | None:
    """The candidates' tries, broadcast, and how many each language has; None if the candidates have more than `limit` bytes."""
    size, count = candidates.agg(F.sum(F.octet_length("phrase") + 8), F.count(F.lit(1))).first()
    if (size or 0) > limit:
        return None
    shard = F.pmod(F.xxhash64("phrase"), F.lit(count // TRIE_PHRASES + 1))
    packed = candidates.select("lang", "phrase", shard.alias("shard")).groupBy("lang", "shard")
    rows = packed.applyInArrow(_packed, "lang string, phrases array<binary>, arrays array<binary>").collect()
    whole = [(r.lang, [bytes(p) for p in r.phrases], [bytes(a) for a in r.arrays]) for r in rows]
    shared = candidates.sparkSession.sparkContext.broadcast(whole)
    sizes = Counter()
    for lang, phrases, _ in whole:
        sizes[lang] += len(phrases)
    return lambda: _Tries(shared.value), list(sizes.values())


def _fits(sizes: list[int], words: int) -> bool:
    """Whether one code holds the language and the numbers of so many words."""
    return max(sizes, default=0) ** words * len(sizes) < 1 << 63


def _part_of_map(table: pa.Table) -> pa.Table:
    """The part of a bit map with the slots of a group set."""
    slots = table["slot"].to_numpy()
    bits = np.zeros(1 << MAP_PART, np.uint8)
    bits[slots & (1 << MAP_PART) - 1] = 1
    return pa.table({"part": pa.array([int(slots[0]) >> MAP_PART], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch.column("code").to_numpy(), MAP_BITS)))], ["slot"])


def _told(candidates: DataFrame) -> Callable[[], np.ndarray]:
    """A bit map of the codes of the candidates, of bounded size, broadcast."""
    slots = candidates.select("code").mapInArrow(_placing, "slot bigint").distinct()
    parts = slots.groupBy(F.shiftright("slot", MAP_PART).alias("part")).applyInArrow(_part_of_map, "part int, bits binary").collect()
    whole = np.zeros(1 << MAP_BITS - 3, np.uint8)
    size = 1 << MAP_PART - 3
    for row in parts:
        whole[row.part * size : (row.part + 1) * size] = np.frombuffer(bytes(row.bits), np.uint8)
    shared = candidates.sparkSession.sparkContext.broadcast(whole.tobytes())
    return lambda: np.frombuffer(shared.value, np.uint8)


def phrase_counts(texts: DataFrame, least: int, longest: int, limit: int = TRIE_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """For each number of words the phrases that occur at least `least` times (`lang`, `phrase`, `n`), and all words by language.

    `texts` has `lang` and the bytes `text`.
    """
    def proposals(words: int) -> DataFrame:
        return texts.mapInArrow(_proposing(words), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))

    def advanced(named: Callable, *way) -> DataFrame:
        counts = texts.mapInArrow(_advancing(*way), _NUMBERED).groupBy("code").agg(F.sum("n").alias("n"))
        frequent = counts.where(F.col("n") >= least)
        return frequent.mapInArrow(named, "lang string, phrase binary, n bigint, code bigint")

    seen = written(proposals(1), "words")
    totals = seen.groupBy("lang").agg(F.sum("n").alias("words"))
    candidates, levels = seen.where(F.col("n") >= least), []
    by_words, coded = None, False
    for words in range(1, longest + 1):
        candidates = written(candidates, "candidates")
        levels.append(candidates.select("lang", "phrase", "n"))
        if words == longest:
            break
        sent = _sent(candidates, limit)
        if words == 1:
            by_words = sent
        if sent:
            candidates, coded = advanced(_naming(sent[0]), words, sent[0]), words == 1
        elif coded and _fits(by_words[1], words + 1):
            candidates = advanced(_naming(by_words[0], words + 1), words, by_words[0], _told(candidates))
        else:
            candidates, coded = proposals(words + 1).where(F.col("n") >= least), False
    return levels, totals


def _with_frequency(phrases: DataFrame, part: str, counts: DataFrame, name: str) -> DataFrame:
    """Adds how often a part of each phrase occurs."""
    key = phrases.withColumn("_key", F.struct("lang", part))
    lookup = counts.select(F.struct("lang", F.col("phrase").alias(part)).alias("_key"), F.col("n").alias(name))
    return written(lookup_join(key, lookup, "_key", split_hot=True).drop("_key"), "parts")


def _score(a: str, left: str, right: str, scale: int) -> Column:
    """floor(scale * a * a / (left * right)), exact for counts below 10^15."""
    one, other, third = (F.col(c).cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", one * one * F.lit(scale).cast("decimal(7,0)"), other * third)


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
    percent: int = PERCENT, trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """Rows `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`: the first `top` phrases of each language.

    Texts are cut at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words (A-Z lower-cased). A phrase of 2 to
    `longest` words with frequency a >= `least` is cut in two where floor(10^6 a a / (l r)) is lowest, the first such place; l and r are the
    frequencies of its halves, n all words of the language. Phrases inside a longer one that occurs at least `percent` of a times are
    dropped. Order: score, then a, falling, then the bytes of the phrase.

    Null texts count as empty, a null language as "und". Repeated rows count each. An empty table gives an empty one. Other columns
    are not read.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    texts = df.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
    )
    levels, totals = phrase_counts(texts, least, longest, trie_bytes)
    out, inside = [], None
    for words in range(longest, 1, -1):
        phrases = levels[words - 1]
        names = F.split(F.col("phrase").cast("string"), " ")
        rows = phrases.select("lang", "phrase", F.col("n").alias("a"))
        cuts = []
        for k in range(1, words):
            for part, size, at in (("head", k, 1), ("rest", words - k, k + 1)):
                rows = rows.withColumn(part, F.array_join(F.slice(names, at, size), " ").cast("binary"))
                rows = _with_frequency(rows, part, levels[size - 1], f"{part}_n").drop(part)
            cut = F.struct(_score("a", "head_n", "rest_n", SCALE).alias("score"), F.lit(k).alias("k"), F.col("head_n").alias("l"), F.col("rest_n").alias("r"))
            rows = rows.withColumn(f"cut_{k}", cut).drop("head_n", "rest_n")
            cuts.append(f"cut_{k}")
        rows = rows.select("lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else F.col(cuts[0])).alias("cut"))
        if inside is not None:
            longer = inside.where(F.col("words") == words).select("lang", "phrase", "longer")
            rows = rows.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
        out.append(rows)
        parts = [F.struct(F.lit(size).alias("words"), F.array_join(F.slice(names, at, size), " ").cast("binary").alias("phrase"))
                 for size in range(2, words) for at in range(1, words - size + 2)]
        if parts:
            own = phrases.select("lang", F.col("n").alias("longer"), F.explode(F.array(*parts)).alias("part")).select("lang", "part.*", "longer")
            both = own if inside is None else inside.unionByName(own)
            inside = both.groupBy("lang", "words", "phrase").agg(F.max("longer").alias("longer"))
    every = out[0]
    for more in out[1:]:
        every = every.unionAll(more)
    every = every.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # Within each of many parts of a language first, so that no task ranks more than the first of each part.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(1, partitions(df))))
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    firsts = every.withColumn("part", part).withColumn("place", within).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    ranked = firsts.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
