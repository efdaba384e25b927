"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from veilspark.llm import collocations as co  # noqa: E402


def brute(rows, least, longest, top, percent=50):
    counts, totals, langs = Counter(), Counter(), set()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    kept = {key: n for key, n in counts.items() if n >= least and len(key[1]) > 1}
    out = defaultdict(list)
    for (lang, words), a in kept.items():
        longer = [n for (other, w), n in kept.items() if other == lang and len(w) > len(words)
                  and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * n >= percent * a for n in longer):
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, left, right = min(((1_000_000 * a * a // (x * y), x, y) for x, y in cuts), key=lambda c: c[0])
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, x, y, totals[lang], -s)
        for lang, items in out.items() for i, (s, a, p, x, y) in enumerate(sorted(items)[:top])
    )


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "B", "new", "York", "é", "日本", "x-y", "\x1c", "\x00", "w" * 120, "of the", "New York city", "a  b"]
    rows = []
    for _ in range(250):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "!"]) for _ in range(rng.randint(0, 15)))
        rows.append((text, rng.choice(["en", "en", "fr", None, ""])))
    return rows + [(None, "en"), ("", None), ("lone", "de"), ("long words " * 9000, "en")] + [rows[3]] * 12


@pytest.mark.parametrize("trie_bytes", [co.TRIE_BYTES, 400, 0])
@pytest.mark.parametrize("longest, top", [(3, 1000), (4, 5)])
def test_phrases(spark, trie_bytes, longest, top):
    rows = corpus(longest)
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "text string, lang string, n int, score double, phrase string")
    got = co.collocations(df.repartition(5), least=6, longest=longest, top=top, trie_bytes=trie_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 6, longest, top)
    assert len(want) > 10 and sorted(tuple(r) for r in got.collect()) == want


def test_empty_and_products_beyond_64_bits(spark):
    df = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert co.collocations(df).count() == 0 and co.collocations(df.limit(0)).count() == 0
    a, x, y = 3_000_000_000_001, 5_000_000_000_007, 7_000_000_000_011
    row = spark.createDataFrame([(a, x, y)], "a long, l long, r long").select(co._score("a", "l", "r", co.SCALE).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (x * y)


def test_trie_finds_exactly_its_phrases():
    rng = random.Random(1)

    def some(count):
        return [bytes(rng.choice(b"abcdefgh \xc3\xa9\x00\xff") for _ in range(rng.choice([1, 2, 3, 9, 14, 200]))) for _ in range(count)]

    for count in (0, 1, 40, 3000):
        trie = co.Trie(list(set(some(count))))
        asked = [*trie.phrases, *(p[:-1] for p in trie.phrases if len(p) > 1), *some(500)]
        ends = np.cumsum([len(p) for p in asked])
        found = trie.match(np.frombuffer(b"".join(asked), np.uint8), ends - [len(p) for p in asked], ends)
        places = {p: i for i, p in enumerate(trie.phrases)}
        assert found.tolist() == [places.get(p, -1) for p in asked]
        cells = trie.base.copy()
        assert len(cells) == len(trie.check) == len(trie.accept)


def test_levels_without_tries_propose_numbers_of_frequent_parts_only(spark, monkeypatch):
    """Words fit the bound and pairs do not: phrases of three words go out as numbers, and only if both pairs in them are frequent."""
    rng, plain, proposed = random.Random(7), [], []
    rows = [(" ".join(f"w{int(41 * rng.random() ** 3)}" for _ in range(60)) + " in the end", "en") for _ in range(60)]
    make, advance = co._proposing, co._advancing
    monkeypatch.setattr(co, "_proposing", lambda words: plain.append(words) or make(words))
    monkeypatch.setattr(co, "_advancing", lambda *way: proposed.append(way) or advance(*way))
    texts = spark.createDataFrame([(t.encode(), lang) for t, lang in rows], "text binary, lang string").repartition(5)
    levels, _ = co.phrase_counts(texts, 6, 3, limit=1_000)
    assert [level.count() for level in levels] == [sum(n >= 6 for n in _counted(rows, k).values()) for k in (1, 2, 3)]
    assert plain == [1] and len(proposed[-1]) == 3
    sent = sum(b.num_rows for b in _sent_rows(texts, co._advancing(*proposed[-1])))
    assert 0 < sent < len(_counted(rows, 3)) / 2


def _counted(rows, words):
    counts = Counter()
    for text, _ in rows:
        own = text.split()
        counts.update(zip(*(own[j:] for j in range(words))))
    return counts


def _sent_rows(texts, advance):
    batch = texts.toArrow().combine_chunks().to_batches()
    return list(advance(iter(batch)))


def test_the_last_level_is_not_counted_again(spark, monkeypatch):
    levels, advance = [], co._advancing
    monkeypatch.setattr(co, "_advancing", lambda words, *way: levels.append(words) or advance(words, *way))
    df = spark.createDataFrame([("a b c d", "en")] * 20, "text string, lang string")
    assert {r.phrase: r.a for r in co.collocations(df).collect()} == {"a b c": 20, "b c d": 20}
    assert levels == [1, 2]
