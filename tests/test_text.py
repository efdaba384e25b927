import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veilspark.config import EngineConfig
from veilspark.functions import anonymizers, columns as C, recognizers as R, spans as sp, tokens
from veilspark.operators import explain, text

SAMPLE_TEXT = (
    "Mona Keller moved to Linz. Write to mona.keller@example.org or ring +974 5512 3456. The card "
    "5555555555554444 belongs to customer CUST-AT-00451907, see CASE-2027-0412."
)


@pytest.fixture(scope="module")
def texts(spark):
    def build(*values):
        return spark.createDataFrame(list(enumerate(values)), "id long, text string")

    return build


def found_types(df, **options):
    return [set(r.t) for r in text.analyze(df, **options).orderBy("id").select(
        text.entity_types(F.col("entities")).alias("t")).collect()]


DETECTED = [
    ("write to mona.keller@example.org", "EMAIL_ADDRESS"),
    ("ring +974 5512 3456", "PHONE_NUMBER"),
    ("call (743) 555-3824 now", "PHONE_NUMBER"),
    ("customer CUST-AT-00451907", "CUSTOMER_ID"),
    ("customer cust-1234567", "CUSTOMER_ID"),
    ("see CASE-2027-0412", "CASE_ID"),
    ("card 4111 1111 1111 1111", "CREDIT_CARD"),
    ("from 203.0.113.10", "IP_ADDRESS"),
    ("see https://example.com/x?y=1", "URL"),
    ("pay GB82 WEST 1234 5698 7654 32", "IBAN_CODE"),
    ("ssn 123-45-6789", "US_SSN"),
    ("on 2026-01-20", "DATE_TIME"),
]
NOT_DETECTED = [
    ("card 4111 1111 1111 1112", "CREDIT_CARD"),
    ("pay GB82 WEST 1234 5698 7654 33", "IBAN_CODE"),
    ("ssn 666-45-6789", "US_SSN"),
    ("ip 300.1.1.1", "IP_ADDRESS"),
    ("éCUST-1234567", "CUSTOMER_ID"),
    ("CASE-20260-0001", "CASE_ID"),
]


def test_detects(texts):
    found = found_types(texts(*[value for value, _ in DETECTED]))
    assert [(v, t) for (v, t), types in zip(DETECTED, found) if t not in types] == []


def test_does_not_detect(texts):
    found = found_types(texts(*[value for value, _ in NOT_DETECTED]))
    assert [(v, t) for (v, t), types in zip(NOT_DETECTED, found) if t in types] == []


def test_person_and_place_from_a_dictionary(spark, texts):
    names = spark.createDataFrame(
        [("Mona Keller", "PERSON"), ("Linz", "LOCATION"), ("Keller", "PERSON"), ("New York City", "LOCATION")],
        "phrase string, entity_type string",
    )
    docs = texts("MONA keller asked for a card in Linz.", "Monali Kellerman", "new york city, New York")
    hits = text.gather_spans(text.dictionary_entities(docs, "id", "text", names), "id")
    joined = docs.join(hits, "id", "left")
    rows = text.analyze(joined, extra=[F.col("dictionary_spans")], config=EngineConfig()).orderBy("id").collect()
    assert [(e.entity_type, e.text_preview) for e in rows[0].entities] == [
        ("PERSON", "MONA keller"), ("LOCATION", "Linz"),
    ]
    assert rows[1].entities == []
    assert [e.text_preview for e in rows[2].entities] == ["new york city"]


def test_anonymize_sample(texts):
    row = text.anonymize(texts(SAMPLE_TEXT), config=EngineConfig(include_original=True)).first()
    assert row.anonymized_text == (
        "Mona Keller moved to Linz. Write to <EMAIL_ADDRESS> or ring <PHONE_NUMBER>. The card <CREDIT_CARD> "
        "belongs to customer <CUSTOMER_ID>, see <CASE_ID>."
    )
    assert row.operator_used == "replace" and row.original_text == SAMPLE_TEXT
    assert [SAMPLE_TEXT[e.start : e.end] for e in row.entities] == [e.text_preview for e in row.entities]


def test_modes(texts):
    masked = text.anonymize(texts(SAMPLE_TEXT), mode=" Mask ").first().anonymized_text
    assert "*" * 23 in masked and "mona" not in masked and "<PII>" in masked
    redacted = text.anonymize(texts(SAMPLE_TEXT), mode="redact")
    assert "redacted_text" in redacted.columns and "Write to  or ring ." in redacted.first().redacted_text
    with pytest.raises(ValueError):
        text.anonymize(texts("x"), mode="hash")


def test_star_limit_and_option(texts):
    long = "a" * 120 + "@example.com"
    kept = text.anonymize(texts(long), mode="mask").first().anonymized_text
    assert kept == "*" * 100 + long[100:]
    assert text.anonymize(texts(long), mode="mask", mask_all=True).first().anonymized_text == "*" * len(long)


def test_originals_are_left_out_by_default(texts):
    row = text.anonymize(texts(SAMPLE_TEXT)).first()
    assert "text" not in row.asDict() and "original_text" not in row.asDict()
    assert all(e.text_preview is None for e in row.entities)


def test_empty_and_null(texts):
    rows = text.anonymize(texts("", None)).orderBy("id").collect()
    assert rows[0].entities == [] and rows[0].anonymized_text == ""
    assert rows[1].entities is None and rows[1].anonymized_text is None


def test_threshold_needs_context(texts):
    assert found_types(texts("CUST-AT-00451907", "customer id CUST-AT-00451907"), threshold=0.99) == [
        set(), {"CUSTOMER_ID"},
    ]


def test_context_is_five_tokens(texts):
    near = "client a b c d CUST-1234567"
    far = "client a b c d e CUST-1234567"
    rows = text.analyze(texts(near, far)).orderBy("id").collect()
    assert [r.entities[0].score for r in rows] == [1.0, 0.85]


def test_context_as_read_from_the_whole_prefix(texts):
    """Brute force over the text before each match, with all kinds of white space, glued words and empty tokens."""
    rnd = random.Random(3)
    parts = ["email", "Mail:", "x", "\U0001f600", "a@b.co", "q7@c.de,r@d.fr", "e-mail=", "é", "email1@x.io", "my_email", ""]
    values = [
        "".join(rnd.choice(parts) + rnd.choice([" ", "  ", "\n", "\t", ",", "", "\u00a0"]) for _ in range(rnd.randrange(40)))
        for _ in range(200)
    ]
    registry = (R.Recognizer("E", r"\b[a-z0-9]+@[a-z]+\.[a-z]+", 0.5, ("email", "mail")), R.Recognizer("D", "[0-9]", 0.5, ("x",)))
    rows = texts(*values).select("text", R.analyze(F.col("text"), registry, 0.0).alias("found")).collect()
    words = {"E": {"email", "mail"}, "D": {"x"}}
    seen = set()
    for row in rows:
        for s in row.found:
            tokens_before = re.sub(r"\s+", " ", row.text[: s.start]).rstrip(" ").split(" ")[-5:]
            near = set(re.split(r"\W+", " ".join(tokens_before).lower())) & words[s.entity_type]
            assert s.score == (0.85 if near else 0.5), (row.text, s)
            assert row.text[s.start : s.end] == s.text_preview
            seen.add((s.entity_type, bool(near)))
    assert len(seen) == 4


def test_cut_by_blocks(texts):
    value = "a\U0001f600\n" * 400
    df = texts(value).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(1200), F.lit(37)))).withColumn(
        "to", F.least(F.col("at") + F.col("at") % 600, F.lit(1200)))
    rows = df.withColumn("b", sp.in_blocks(F.col("text"))).select("at", "to", sp.cut(F.col("b"), F.col("at"), F.col("to")).alias("c"))
    assert all(r.c == value[r.at : r.to] for r in rows.collect())


def test_overlaps_cover_everything(texts):
    registry = (
        R.Recognizer("LOW", r"bbb ccc ddd", 0.4),
        R.Recognizer("HIGH", r"ccc", 0.9),
        R.Recognizer("LEFT", r"aaa bbb", 0.8),
        R.Recognizer("SAME", r"ccc", 0.95),
    )
    row = text.anonymize(texts("x aaa bbb ccc ddd y"), registry=registry, operators={
        n: anonymizers.replace_with(f"<{n}>") for n in ("LOW", "HIGH", "LEFT", "SAME")}).first()
    assert row.anonymized_text == "x <LEFT><LOW> y"
    assert len(row.entities) == 4


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from([0.4, 0.9]), st.sampled_from("ABC")), max_size=25))
def test_overlaps_against_brute_force(spark, drawn):
    value = "é" + "0123456789" * 5
    spans = [(t, s, s + n, p, value[s : s + n]) for s, n, p, t in drawn]
    df = spark.createDataFrame([(value, spans)], f"text string, spans {sp.SPANS_TYPE}")
    row = df.select(
        sp.resolve_overlaps(F.col("spans")).alias("kept"),
        sp.replace_spans(F.col("text"), sp.resolve_overlaps(F.col("spans")), lambda t, v: F.repeat(F.lit("#"), F.length(v))).alias("out"),
    ).first()
    covered = {i for _, s, e, _, _ in spans for i in range(s, e)}
    assert row.out == "".join("#" if i in covered else c for i, c in enumerate(value))
    ends = [(k.start, k.end) for k in row.kept]
    assert ends == sorted(ends) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    whole = {(s, e) for _, s, e, _, _ in spans}
    outer = [(s, e) for s, e in whole if not any((a, b) != (s, e) and a <= s and b >= e for a, b in whole)]
    assert [k[0] for k in ends] == sorted(s for s, _ in outer)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=60))
def test_running_sum(spark, values):
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(sp.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("r")).first().r
    assert got == [sum(values[: i + 1]) for i in range(len(values))]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "é", " ", "x.y@z.org", "\n", "@", "日本"]), max_size=30))
def test_spans_against_python(spark, parts):
    value = "".join(parts)
    df = spark.createDataFrame([(value,)], "text string")
    got = df.select(sp.find_spans(F.col("text"), R.EMAIL.regex).alias("s")).first().s
    expected = [(m.start(), m.end(), m.group()) for m in re.finditer(R.EMAIL.pattern, value, re.IGNORECASE)]
    assert [tuple(s) for s in got] == expected


def test_many_hits_in_one_text(spark):
    n = 2_000
    df = spark.range(1).select(F.repeat(F.lit("call a@b.co or "), F.lit(n)).alias("text"))
    row = text.anonymize(df, registry=(R.EMAIL,)).select("anonymized_text", F.size("entities").alias("n")).first()
    assert row.n == n and row.anonymized_text == "call <EMAIL_ADDRESS> or " * n


def test_added_recognizer(texts):
    custom = R.Recognizer("TICKET", r"\bT-\d+\b", 0.5, ("ticket",))
    row = text.analyze(texts("ticket T-77 and T-78"), registry=(custom,)).first()
    assert [(e.text_preview, e.score) for e in row.entities] == [("T-77", 0.85), ("T-78", 0.85)]
    with pytest.raises(ValueError):
        R.Recognizer("BAD", "x", 1.5)


def test_model_status(spark, texts):
    def load():
        def find(value):
            if "boom" in value:
                raise RuntimeError("no")
            return [{"entity_type": "PERSON", "start": 0, "end": 4, "score": 0.9}]

        return find

    def broken():
        raise ImportError("no model")

    docs = texts("John here", "boom", "")
    scanned = docs.withColumn("m", text.model_recognizer(load)(F.col("text")))
    scanned = text.with_scan(
        scanned, "scan", "text", "L", extra=F.col("m.spans"), extra_status=F.col("m.status"),
        config=EngineConfig(include_original=True),
    )
    rows = scanned.orderBy("id").select("scan.*").collect()
    assert [(r.status, r.entity_count) for r in rows] == [("completed", 1), ("failed", 0), ("completed", 0)]
    assert rows[0].entities[0].text_preview == "John" and rows[0].scanned_text == "John here"
    missing = docs.withColumn("m", text.model_recognizer(broken)(F.col("text")))
    missing = text.with_scan(missing, "scan", "text", "L", extra=F.col("m.spans"), extra_status=F.col("m.status"))
    assert {r.status for r in missing.select("scan.status").collect()} == {"unavailable"}


def test_tokenize_operator_is_reversible(spark, texts, ring, config):
    docs = texts("mail a@b.co please").withColumn("_k", ring.keys("v1"))
    operators = {"EMAIL_ADDRESS": anonymizers.tokenize_with("EMAIL_ADDRESS", "v1", F.col("_k"), config.domain)}
    done = text.anonymize(docs, operators=operators)
    assert "a@b.co" not in done.first().anonymized_text
    back = explain.unmask_texts(done, ring, config, text_col="anonymized_text")
    assert back.first().text == "mail a@b.co please"


# --- tokens -------------------------------------------------------------------------------------


def masked_text(spark, ring, config, value, pairs):
    df = spark.createDataFrame([(value, pairs)], "text string, replacements array<struct<key:string,value:string>>")
    return explain.mask_texts(df, ring, config)


def test_mask_text_example(spark, ring, config):
    pairs = [("customer_name", "John"), ("amount", "310.25"), ("merchant_name", "CARREFOUR")]
    df = masked_text(spark, ring, config, "Call John about 310.25 QAR at CARREFOUR", pairs)
    masked = df.first().masked_text
    assert re.fullmatch(
        r"Call \[\[ENC\|v1\|customer_name\|\S+\]\] about \[\[ENC\|v1\|amount\|\S+\]\] QAR at \[\[ENC\|v1\|merchant_name\|\S+\]\]",
        masked,
    )
    assert explain.unmask_texts(df.select("masked_text"), ring, config).first().text == "Call John about 310.25 QAR at CARREFOUR"


def test_placeholders_win_and_nulls_are_skipped(spark, ring, config):
    pairs = [("name", "John"), ("gone", None), ("empty", ""), ("blank", "")]
    masked = masked_text(spark, ring, config, "{{name}} is not John, {{blank}}", pairs).first().masked_text
    assert " is not John, [[ENC|v1|blank|" in masked and masked.startswith("[[ENC|v1|name|")


def test_later_values_do_not_break_tokens(spark, ring, config):
    pairs = [("name", "John"), ("a", "ENC"), ("b", "v1"), ("c", "name"), ("d", "1")]
    df = masked_text(spark, ring, config, "John ENC v1 name 1", pairs)
    assert explain.unmask_texts(df.select("masked_text"), ring, config).first().text == "John ENC v1 name 1"


def test_replacement_order_counts(spark, ring, config):
    df = masked_text(spark, ring, config, "Mona Keller", [("short", "Mona"), ("long", "Mona Keller")])
    assert "short" in df.first().masked_text and "long" not in df.first().masked_text


def test_bad_fields_and_reserved_characters(spark, ring, config):
    with pytest.raises(tokens.TextMaskingError):
        tokens.make_token("a|b", F.lit("x"), "v1", F.lit(None), "d")
    with pytest.raises(Exception, match="replacement key"):
        masked_text(spark, ring, config, "x", [("a|b", "x")]).collect()
    with pytest.raises(Exception, match="reserved character"):
        masked_text(spark, ring, config, "x \ue001", [("a", "x")]).collect()


def test_unmask_errors(spark, ring, config):
    df = spark.createDataFrame([("no token",)], "masked_text string")
    with pytest.raises(Exception, match="No ENC tokens"):
        explain.unmask_texts(df, ring, config).collect()
    forged = ["A", "AA", "A" * 43 + "=", "A" * 44, "A" * 50, "A" * 64 + "=="]
    df = spark.createDataFrame([(f"x [[ENC|v1|f|{c}]] y",) for c in forged], "masked_text string")
    rows = explain.unmask_texts(df, ring, config, on_error="null").collect()
    assert {r.problem for r in rows} == {"Failed to decrypt token for field 'f'"}
    old = spark.createDataFrame([("[[ENC|v9|f|" + "A" * 44 + "]]",)], "masked_text string")
    assert explain.unmask_texts(old, ring, config, on_error="null").first().text is None


def test_enc_token_is_a_full_match(spark):
    values = ["[[ENC|v1|a|AAAA]]", " [[ENC|v1|a|AAAA]]", "[[ENC|v1|a|AAAA]]\n", "[[ENC|x1|a|AAAA]]", "[[ENC|v1||AAAA]]"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.t for r in df.select(tokens.is_enc_token(F.col("v")).alias("t")).collect()] == [True] + [False] * 4


def test_number_texts(spark):
    values = [50000.0, 310.25, 1e7, 12345678.25, 1e15, 1e16, 1.5e20, 1e-5, -2.5e-7, 0.0, -0.0, 0.001, 1e-4]
    from decimal import Decimal

    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(C.canonical_text(F.col("v"), "double").alias("t"), C.fixed_decimals(F.col("v"), 2).alias("f")).collect()
    assert [r.t for r in rows] == [format(Decimal(str(v)), "f") for v in values]
    assert [r.f for r in rows] == [f"{v:.2f}" for v in values]
    ties = spark.createDataFrame([(2.675,), (0.125,), (1.005,), (0.985,), (0.75,)], "v double")
    got = ties.select(C.fixed_decimals(F.col("v"), 2).alias("f"), C.percent(F.col("v")).alias("p")).collect()
    assert [(r.f, r.p) for r in got] == [(f"{v:.2f}", f"{v:.0%}") for v in (2.675, 0.125, 1.005, 0.985, 0.75)]
    with pytest.raises(ValueError):
        C.canonical_text(F.lit(True), "boolean")


def test_fallback_when_a_token_does_not_open(spark, ring, config):
    result = (
        "named_struct('rm_explanation_masked', 'x [[ENC|v1|a|AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA=]]', "
        "'recommended_actions_masked', array('none'), 'disclaimer_masked', 'd')"
    )
    df = spark.range(1).select(F.expr(result).alias("masked_result"))
    row = explain.unmask_explanation(df, ring, config).first()
    assert row.unmasked_result.rm_explanation == explain.FALLBACK_EXPLANATION
    assert row.unmask_warning.endswith("Failed to decrypt token for field 'a'")
    row = explain.unmask_explanation(df, ring, config, fallback=False).first()
    assert row.unmasked_result is None


def test_values_with_reserved_characters_are_refused(spark, ring, config):
    with pytest.raises(Exception, match="reserved"):
        masked_text(spark, ring, config, "Mona paid", [("name", "Mona"), ("other", "")]).collect()


def test_dictionary_words_end_at_word_boundaries(spark):
    names = spark.createDataFrame([("John Smith", "PERSON"), ("Doha", "LOCATION"), ("St. Louis", "LOCATION")], "phrase string, entity_type string")
    found = {
        "John Smith's account": ["John Smith"], "a Doha-based firm": ["Doha"], "ask John. Smith left": [], "from Doha. Then": ["Doha"],
        "in St. Louis, or St Louis": ["St. Louis", "St Louis"], "Dohas": [],
    }
    docs = spark.createDataFrame(list(enumerate(found)), "id int, text string")
    hits = text.dictionary_entities(docs, "id", "text", names).orderBy("id", "start").collect()
    for i, (value, want) in enumerate(found.items()):
        assert [value[h.start : h.end] for h in hits if h.id == i] == want


def test_dictionary_phrases_of_any_length_and_shared_words(spark):
    long = " ".join(f"word{i % 50}" for i in range(5000))
    names = spark.createDataFrame(
        [(long, "PERSON"), ("a a b", "PERSON"), ("a b", "PERSON"), ("B", "LOCATION"), ("St Mary", "LOCATION"), ("St. Mary", "LOCATION"), ("", "X"), (None, "X")],
        "phrase string, entity_type string",
    )
    values = ["a a a b", f"so {long} it was", "St. Mary and st mary", "no hit", "", None, "b. A b", "a a b at the end a"]
    docs = spark.createDataFrame(list(enumerate(values)) + [(0, "b a a b"), (None, "x b"), (None, "a, b")], "id int, text string")
    hits = text.dictionary_entities(docs, "id", "text", names).collect()
    got = sorted((str(h.id), h.start, h.end, h.entity_type) for h in hits)

    def brute(value):
        import re
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", value or "")]
        phrases = {tuple(re.findall(r"\w+", p.lower())): t for p, t in [(long, "PERSON"), ("a a b", "PERSON"), ("a b", "PERSON"), ("B", "LOCATION"), ("St Mary", "LOCATION")]}
        for i in range(len(words)):
            for phrase, kind in phrases.items():
                run = words[i : i + len(phrase)]
                if tuple(w[2] for w in run) == phrase:
                    yield run[0][0], run[-1][1], kind

    want = sorted((str(i), *span) for i, value in [*enumerate(values), (0, "b a a b"), (None, "x b"), (None, "a, b")] for span in brute(value))
    assert got == want and len(want) > 15


def test_corpus_leaks_are_substrings(spark):
    from veilspark.operators import reports

    values = ["Mona Keller", "keller", "KELLER", "abc", None, "", "aaaaa", "aaaaaaa", "ünïcödé", "🙂🙃🙂🙃🙂", "a.b*c"]
    texts = ["xMONA KELLERy", "Kellerman and kelle r", "aaaaaa", "", None, "ÜNÏCÖDÉ🙂🙃🙂🙃🙂", "a.b*c aXbYc abc", "mona\nkeller"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, "aaaaa", 1), (None, "KELLER", 1)], "id int, text string, value int")
    sought = spark.createDataFrame([(v,) for v in values], "v string")
    got = sorted((str(r.id), r.value) for r in reports.corpus_leaks(df, "id", "text", sought, "v").collect())
    lowered = {v.lower() for v in values if v and len(v) >= 5}
    rows = [*enumerate(texts), (0, "aaaaa"), (None, "KELLER")]
    assert got == sorted((str(i), v) for i, t in rows for v in lowered if t and v in t.lower())
    assert reports.corpus_leaks(df.limit(0), "id", "text", sought, "v").count() == 0


def test_repeats_by_dominance(spark):
    import random

    from veilspark.functions import spans as sp

    rng = random.Random(3)
    cases = []
    for _ in range(120):
        found = []
        for _ in range(rng.randint(0, 14)):
            at = rng.randint(0, 12)
            found.append((rng.choice("AB"), at, at + rng.randint(1, 8), rng.randint(0, 6) / 8, "x"))
        cases.append(found)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, s {sp.SPANS_TYPE}")
    for row in df.select("i", sp.drop_repeats(F.col("s")).alias("k")).collect():
        found = set(cases[row.i])
        kept = {a for a in found if not any(
            b != a and b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] for b in found)}
        assert sorted(map(tuple, row.k)) == sorted(kept)


def test_dictionary_places_and_sentence_ends_are_looked_for_at_hits_only(spark):
    names = spark.createDataFrame([("Ann Lee", "PERSON"), ("St. Louis", "LOCATION"), ("Doha", "LOCATION")], "phrase string, entity_type string")
    value = "\ue123 é, Ann, Lee? Ann... Lee \U0001f600 Ann?’ Lee; Ann.x Lee ann.Lee st. LOUIS " + "St, Louis. - Doha " * 60
    docs = spark.createDataFrame([(1, value), (2, "Doha"), (3, ""), (4, "...")], "id int, text string")
    hits = text.dictionary_entities(docs, "id", "text", names)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(_text#" in plan and "regexp_extract(" not in plan[: plan.index("regexp_extract_all(_text#")]
    assert text.WORD_PATTERN not in plan[plan.index("_hits#") : plan.index("regexp_extract_all(_text#") + 200]
    got = {(h.id, h.start, h.end) for h in hits.collect()}
    want = {(1, m.start(), m.end()) for m in re.finditer(r"Ann, Lee|ann\.Lee|st\. LOUIS|St, Louis|Doha", value)} | {(2, 0, 4)}
    assert got == want and len(want) == 124


@pytest.mark.parametrize("values", [[], [5], [3, 0, 4], list(range(23))])
def test_sums_before_a_place(spark, values):
    df = spark.createDataFrame([(values,)], "v array<int>").withColumn("s", sp.block_sums(F.col("v")))
    found = df.select(F.transform(F.sequence(F.lit(0), F.lit(len(values))), lambda at: sp.sum_before(F.col("v"), F.col("s"), at)).alias("x"))
    assert found.first().x == [sum(values[:at]) for at in range(len(values) + 1)]


def test_spans_are_worked_out_in_batches_of_texts_that_are_computed(spark, texts):
    """One call for places, contexts and overlaps together, no lambda for each of them, whatever the text is made of."""
    df = texts("mail a@b.co", "", None).select("id", F.concat("text", F.lit(" x")).alias("text"))
    found = text.anonymize(df, registry=(R.EMAIL, R.IBAN, R.CREDIT_CARD))
    plan = found.select("anonymized_text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "array_sort" not in plan and "aggregate(split" not in plan
    assert [r.anonymized_text for r in found.orderBy("id").collect()] == ["mail <EMAIL_ADDRESS> x", " x", None]


def test_matches_whose_text_also_stands_elsewhere(texts):
    """The same characters before, behind or across a match do not move its span; invalid matches count as places."""
    even = R.Recognizer("EVEN", r"\b\d+\b", 0.5, ("no",), validator=lambda v: v.cast("int") % 2 == 0)
    house = R.Recognizer("C", r"\bC-\d\d\b", 0.5, ("no",))
    rnd = random.Random(11)
    parts = ["C-12", "xC-12", "C-123", "\U0001f600", " ", " ", "no", "NO:", "12", "13", "\u00e9", "a12", "-", "\u2003", "\u00b5no", "no\u0301", "\n"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(300)] + ["", "12", "C-12"]
    rows = texts(*values).select("text", R.recognize(F.col("text"), (even, house)).alias("found")).collect()
    word, several = r"[\w\u0301]", 0  # marks belong to words, as in (?U)
    for row in rows:
        want = []
        for r, expression in ((even, r"\d+"), (house, r"C-\d\d")):
            for m in re.finditer(rf"(?<!{word}){expression}(?!{word})", row.text):
                if r is even and int(m[0]) % 2:
                    continue
                before = " ".join(re.sub(r"\s+", " ", row.text[: m.start()]).rstrip(" ").split(" ")[-5:])
                near = "no" in re.findall(rf"{word}+", before.lower())
                score = (1.0 if near or r is even else 0.5) if r is even else (0.85 if near else 0.5)
                want.append((r.entity_type, m.start(), m.end(), score, m[0]))
        assert [tuple(s) for s in row.found] == want, row.text
        several += any(row.text.count(w[4]) > 1 for w in want)
    assert several > 30
