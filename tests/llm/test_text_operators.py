"""Operators that work on each text by itself, against the libraries or a brute-force version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from veilspark.llm import byte_bpe, decontamination, personal_data, token_counts  # noqa: E402

JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
ODD = [
    None, "", " ", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>", "!" * 9000, "ab" * 3000, " " * 900 + "x",
    "\x1c\x1d x", "日本語テキスト" * 30, "🙂👩‍👩‍👧" * 9, "it's IT'S ’s", "\x00\x01", "x" * 3001, "՘ ₏",
]


def mixed_texts(letters, count=250, size=120):
    rng = random.Random(5)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts(spark):
    values = ODD + mixed_texts("ab \n\t'sétÀ9!🙂½²́") + ["the same row"] * 3
    return values, spark.createDataFrame([(i, t, 1) for i, t in enumerate(values)], "doc_id long, text string, n_tokens int")


def test_token_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    values, df = texts
    path = public_tokenizers.path(JSON)
    got = token_counts.token_counts(df, path, limit=20).orderBy("doc_id").collect()
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in values], add_special_tokens=False)]
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in values]
    assert [r.over_limit for r in got] == [n > 20 for n in want]
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_ids_are_the_librarys_and_decode(texts):
    import tiktoken

    values, df = texts
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.encode_and_decode(df, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [library.encode_ordinary(t or "") for t in values]
    assert [bytes(r.decoded) for r in rows] == [(t or "").encode() for t in values]


def test_unknown_ids_fail_and_null_ids_decode_to_nothing(spark):
    path = public_tokenizers.path(RANKS)
    df = spark.createDataFrame([(None,), ([],), ([64],)], "ids array<int>")
    assert [bytes(r.d) for r in df.select(byte_bpe.decoded("ids", path).alias("d")).collect()] == [b"", b"", b"a"]
    bad = spark.createDataFrame([([60_000],)], "ids array<int>")
    with pytest.raises(Exception):
        bad.select(byte_bpe.decoded("ids", path)).collect()


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def contaminated(docs, items, size):
    windows = {}
    for item, text in items:
        words = _WORD.findall(lowered(text))
        for k in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    out = {}
    for doc, text in docs:
        words, hit, found = _WORD.findall(lowered(text)), set(), set()
        for k in range(len(words)):
            for n in {len(w) for w in windows}:
                run = tuple(words[k : k + n])
                if len(run) == n and run in windows:
                    hit.update(range(k, k + n))
                    found |= windows[run]
        ids = sorted(str(i) for i in found if i is not None)
        out[doc] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [8_000_000, 40])
def test_contamination(spark, block_bytes):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for i in range(25)]
    items += [(90, None), (91, ""), (None, "q r s t"), (7, "a B, c!"), (93, "Zürich é")]
    docs = [(i, " ".join(rng.choice("abcdqrst") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(900, None), (901, ""), (902, "b " * 5000), (903, "q r, S t zürich É"), (904, "zürich é")]
    df = spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, contaminated boolean")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(df, bench, window=4, block_bytes=block_bytes)
    rows = {r.doc_id: tuple(r[c] for c in decontamination.RESULTS) for r in got.collect()}
    want = contaminated(docs, items, 4)
    assert rows == want
    clean = decontamination.decontaminated(df, bench, window=4, block_bytes=block_bytes)
    assert {r.doc_id for r in clean.collect()} == {d for d, w in want.items() if not w[4]}
    assert decontamination.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(df.limit(0), bench).count() == 0


_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def counts(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    out = []
    for kind, pattern in _PATTERNS.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in pattern.finditer(text or "") if counts(kind, m[0])]
    return out


def test_base_spans_of_personal_data(spark):
    parts = ["a", "b.", "@", "@", "x", "1", "2", "+", "-", " ", "(", ")", ".", "..", "é", "🙂", "_", "255", "256",
             "4111 1111 1111 1111", "+1 (743) 555-3824", "1.2.3.4", "a@b.c", "\n", "", ""]
    values = mixed_texts(parts, 900, 50)
    values += [None, "", "1 " * 20_000, "a@" + "b." * 20_000 + "c", "9" * 30_000, "x@y.z " * 4000, "a.b@c.d_e@f.g"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(values)], "doc_id long, text string, n_ip int")
    rows = personal_data.personal_data(df).orderBy("doc_id").collect()
    for text, row in zip(values, rows):
        want = base_spans(text)
        assert row.spans.split(",") == (want or [""]), text
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in personal_data.KINDS] == [sum(w.startswith(k) for w in want) for k in personal_data.KINDS]
    assert personal_data.personal_data(df.limit(0)).count() == 0


def test_trees_add_spans_that_look_alike(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        a, b, c = rng.randint(200, 999), rng.randint(100, 999), rng.randint(1000, 9999)
        rows.append((i, f"please call +1 ({a}) {b}-{c} soon, item {rng.randint(10, 99)}-{rng.randint(10**5, 10**6)}-{i}"))
    rows.append((5000, "please call 1 (743) 555-3824 soon"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal_data.train(df)
    assert model.trees and model.thresholds["phone"] <= 1 < model.thresholds["card"]
    found = personal_data.personal_data(df, model)
    row = found.where("doc_id = 5000").first()
    assert row.n_phone == 0 and row.spans == "phone:12:28"
    others = found.where("doc_id < 5000").select(F.size(F.split("spans", ",")).alias("n")).distinct().collect()
    assert [r.n for r in others] == [1]
    assert personal_data.train(df.limit(0)).trees == ()


def test_redaction_of_overlapping_spans(spark):
    df = spark.createDataFrame([("0123456789", [(1, 3), (2, 5), (7, 8)]), ("é", []), (None, [])], "t string, s array<struct<start:long,end:long>>")
    shown = [r.r for r in df.select(personal_data.redacted("t", F.col("s"), "#").alias("r")).collect()]
    assert shown == ["0#56#89", "é", ""]


def calls(count, plain, rng):
    """Texts with a telephone number and an item number; each of `plain` has its number without plus sign."""
    out = []
    for i in range(count):
        a, b, c = rng.randint(200, 999), rng.randint(100, 999), rng.randint(1000, 9999)
        number = f"{a}-{b}-{c}" if i in plain else f"+1 ({a}) {b}-{c}"
        out.append((i, f"please call {number} soon, item {rng.randint(10, 99)}-{rng.randint(10**5, 10**6)}-{i}"))
    return out


@pytest.mark.parametrize("every", [20, 3])
def test_numbers_without_plus_sign_are_no_negatives(spark, every):
    plain = set(range(0, 900, every))
    df = spark.createDataFrame(calls(900, plain, random.Random(every)), "doc_id long, text string")
    model = personal_data.train(df)
    assert model.thresholds["phone"] <= 1
    for row in personal_data.personal_data(df, model).collect():
        assert (row.n_phone == 0) == (row.doc_id in plain)
        assert row.spans == ("phone:12:24" if row.doc_id in plain else "phone:12:29")


def test_thresholds_count_all_rows(spark):
    """A kind in one text of 300 has all its candidates counted: two forms alone, and three in the pair."""
    rows = calls(200, set(), random.Random(6))
    rare = spark.createDataFrame(rows, "doc_id long, text string")
    df = spark.range(1000, 61_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("nothing here "), "id").alias("text")).union(rare)
    counted = personal_data.labelled(df).where("kind = 3 and label = 1").agg(F.sum("n")).first()[0]
    assert counted == 5 * 200
    assert personal_data.train(df).thresholds["phone"] <= 1


def test_numbers_side_by_side(spark):
    rows = calls(900, set(), random.Random(7))
    added = {
        2000: ("(743) 555-3824 (212) 555-0199", "phone:0:14,phone:15:29"),
        2001: ("2026-01-20 743-555-3824", "phone:11:23"),
        2002: ("x" * 70 + ".y@example.org", "email:0:84"),
    }
    df = spark.createDataFrame(rows + [(i, t) for i, (t, _) in added.items()], "doc_id long, text string")
    found = personal_data.personal_data(df, personal_data.train(df)).where("doc_id >= 2000").collect()
    assert {r.doc_id: r.spans for r in found} == {i: s for i, (_, s) in added.items()}
