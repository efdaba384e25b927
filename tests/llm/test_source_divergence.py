"""Source divergence against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from veilspark.llm import source_divergence as sd  # noqa: E402

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sources[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = p(sum((counts[lang, s] for s in own), Counter()))
        by = {s: p(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(sum(abs(by[s][t] - by[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(by[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and by[s][t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def corpus(seed, size=300):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "Dd", "é", "École", "日本", "x", "yy", "z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(size):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "", "ü"])
        skew = words[: 3 + len(source or "") * 5]
        rows.append((rng.choice(" ,1\n").join(rng.choice(skew) for _ in range(rng.randint(0, 12))), lang, source))
    rows += [(None, "en", "silent"), ("", "de", "only"), ("once", "it", "a"), ("twice", "it", "b"), ("it it", "it", None)]
    return rows + [rows[0]] * 5 + [("long " * 20_000, "en", "s2")]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_terms(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "text string, lang string, source string, p int, term string, n double")
    got = sd.source_divergence(df.repartition(5), least_documents=3, top_terms=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 4)


def test_nothing_kept_and_empty_table(spark):
    rows = [("a b", "en", "s1"), ("a", "en", "s2"), ("c", "fr", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, sd.source_divergence(df).collect())) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]
    assert sd.source_divergence(df.limit(0)).count() == 0


def test_counts_beyond_64_bits_stay_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000_001, 9_000_000_000_000_007, 3)], "n long, total long, kept long")
    want = 1 + 1_000_000_000 * (9_000_000_000_000_001 + 5) // (9_000_000_000_000_007 + 15)
    assert df.select(sd._probability("n", "total", "kept").alias("p")).first().p == want


def test_tasks_hand_on_what_they_hold(monkeypatch):
    rows = [(t or "", lang or "", s or "") for t, lang, s in corpus(3)]
    columns = [pa.array([r[0].encode() for r in rows], pa.binary())] + [pa.array([r[i] for r in rows]) for i in (1, 2)]
    batch = pa.RecordBatch.from_arrays(columns, ["text", "lang", "source"])

    def totals():
        sums = Counter()
        for out in sd._count_terms(iter([batch])):
            for lang, source, term, docs, n in zip(*(c.to_pylist() for c in out.columns)):
                sums[lang, source, term, "docs"] += docs
                sums[lang, source, term, "n"] += n
        return sums

    at_once = totals()
    monkeypatch.setattr(sd, "HELD_TERMS", 7)
    assert totals() == at_once


def test_tree_meets_every_pair_once(monkeypatch):
    rng = random.Random(4)
    rows = []
    for lang in ("a", "b"):
        z = [rng.randint(1, 40) for _ in range(6)]
        for _ in range(80):
            own = sorted(rng.sample(range(6), rng.randint(1, 5)))
            rows.append((lang, tuple((s, rng.choice([z[s], z[s] + 3, 60]), z[s]) for s in own), rng.randint(1, 4)))
    rows.sort()
    want = Counter()
    for lang, row, times in rows:
        for i, (s, p, z) in enumerate(row):
            for t, q, y in row[:i]:
                want[lang, t, s] += times * (abs(p - q) - abs(q - z) - abs(y - p) + abs(y - z))
    kind = pa.list_(pa.struct([("source", pa.int32()), ("p", pa.int64()), ("z", pa.int64())]))
    for held in (sd.HELD_PAIRS, 3):
        monkeypatch.setattr(sd, "HELD_PAIRS", held)
        batches = []
        for part in (rows[:50], rows[50:51], rows[51:]):
            values = [[{"source": s, "p": p, "z": z} for s, p, z in r[1]] for r in part]
            columns = [pa.array([r[0] for r in part]), pa.array(values, kind), pa.array([r[2] for r in part])]
            batches.append(pa.RecordBatch.from_arrays(columns, ["lang", "row", "times"]))
        got = Counter()
        for out in sd._meet_in_tree(iter(batches)):
            for lang, a, b, value in zip(*(c.to_pylist() for c in out.columns)):
                got[lang, a, b] += value
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
