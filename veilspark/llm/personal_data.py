"""Personal data by gradient boosting over candidate spans.

Strict patterns give the base spans, which always stay. Wider generators propose candidates: anything around an at sign,
dotted quadruples, and all overlapping spans from one group of digits to another in a run of digits and separators that have as
many digits as a telephone or card number. Boosted trees for each kind score a candidate by its format and its context. They
learn from the corpus itself. Positive are the base spans, without what the strict patterns decide by (the plus sign and the
country code, the check digit, the range of the parts). Negative are only candidates known to be none: parts of base spans,
dates, numbers behind a word like "item" or grown together with letters, failed check digits and ranges, domains of one label. All
other candidates are unlabelled: they neither train nor calibrate. A threshold for each kind, chosen on candidates not used for
training, is the lowest at which nearly all labelled ones above it are positive. Of overlapping spans the one with the best score is
added, the longest of equal ones.

Labelled candidates of all rows are counted by their features in one pass; training and thresholds read the counts.

All of it is built-in expressions in the JVM. Patterns repeat single characters only, so no text can exhaust their stack;
offsets come from running sums over matches and the gaps between them, in n log n.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.functions.crypto import bind
from veilspark.llm.tables import fresh, whole, with_results, written

KINDS = ("email", "ip", "card", "phone")

RESULTS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

#: The share of positive ones among the labelled candidates above a threshold.
PRECISION = 0.99

#: Positive candidates of a kind that are needed to set its threshold; with fewer nothing is added.
CALIBRATION_CANDIDATES = 20

_JOIN, _DOT, _OTHER = "\ue000", "\ue001", "\ue002"

#: The strict patterns, on texts in which a separator between digits is _JOIN and a dot between labels is _DOT.
_STRICT = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{_DOT}-]))[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{_JOIN}]+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WIDE = {
    "email": r"(?<![^\s@<>()])[^\s@<>()]++@[^\s@<>()]++",
    "ip": r"[0-9]{1,4}+[.,:][0-9]{1,4}+[.,:][0-9]{1,4}+[.,:][0-9]{1,4}+",
}
_FEATURES = (
    "kind", "size", "digits", "separators", "brackets", "dots", "first_group", "last_group", "last_letters", "glued_before", "glued_after", "assigned",
    "leading", "joined_before", "joined_after",
)

#: What stands for known spans in the text that numbers are taken from: marks before and behind them, or a blank for each character.
_OPEN, _PAIR, _CLOSE, _BLANK = {"phone": "\ue010", "card": "\ue011", "ip": "\ue012", "date": "\ue013"}, "\ue016", "\ue014", "\ue015"
_MARKS = "".join(_OPEN.values()) + _PAIR + _CLOSE + _BLANK
_HYPHEN = "\ue003"

_DATE = (
    r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}([-./])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])"
    r"|(?:0[1-9]|[12][0-9]|3[01])([-./])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
)

#: Words before a number that is none of a person.
_ITEM_WORDS = (
    "item", "items", "order", "invoice", "article", "art", "sku", "part", "serial", "ticket", "version", "page", "isbn", "issn", "ean", "lot", "batch",
    "artikel", "bestellung", "rechnung", "seite", "commande", "facture", "pedido", "factura", "articolo", "ordine",
)

#: Digits of a telephone and of a card number, and the most groups of digits in one.
_SIZES = {"card": (12, 19), "phone": (7, 15)}
_MOST_DIGITS = 19


def _pieces(text: Column, pattern: str) -> Column:
    """Each gap with the match behind it; the last gap has none."""
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit(None).cast("string")))
    return F.zip_with(F.split(text, pattern, -1), found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))


def _running(values: Column, join) -> Column:
    """The running sum (or another associative join) of numbers, by doubling steps."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(
        steps,
        values.cast("array<bigint>"),
        lambda sums, s: F.transform(
            sums, lambda v, i: join(v, F.coalesce(F.get(sums, i - F.pow(F.lit(2), s).cast("int")), F.lit(0).cast("bigint")))
        ),
    )


def _ends(pieces: Column) -> Column:
    """The running sum of the lengths of gaps and matches."""
    return _running(F.transform(pieces, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))), lambda a, b: a + b)


def _spans(pieces: Column) -> Column:
    """The matches with their first and last offset, and the characters around them."""
    after = F.concat(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.left(p["gap"], F.lit(1))), F.array(F.lit("")))
    with_end = F.zip_with(pieces, _ends(pieces), lambda p, end: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), end.alias("end")))
    all_ = F.zip_with(
        with_end,
        after,
        lambda p, a: F.struct(
            p["match"].alias("match"), F.right(p["gap"], F.lit(1)).alias("before"), a.alias("after"),
            (p["end"] - F.length(p["match"])).alias("start"), p["end"].alias("end"),
        ),
    )
    return F.filter(all_, lambda s: s["match"].isNotNull())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    values = F.transform(
        F.split(F.reverse(_digits(match)), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of a strict pattern counts."""
    count = F.length(_digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(match, r"\.")
        return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.right(p, F.lit(9)).cast("int") <= 255)
    if kind == "card":
        return F.when(count.between(13, 19), _luhn(match)).otherwise(False)
    return count.between(9, 15)


def _joined(text: Column) -> Column:
    """The text with single separators between digits marked; as long as before."""
    return F.regexp_replace(F.translate(text, _JOIN, _OTHER), "(?<=[0-9])[ -](?=[0-9])", _JOIN)


def _dotted(text: Column) -> Column:
    """The text with dots between labels marked; as long as before."""
    return F.regexp_replace(F.translate(text, _DOT, _OTHER), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)


def _confirmed(found: Column, kind: str) -> Column:
    good = F.filter(found, lambda s: _valid(kind, s["match"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


_VIEWS = {"email": _dotted, "ip": lambda t: t, "card": _joined, "phone": lambda t: t}
_HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "number": "[0-9]"}


def _holds(kind: str, match: Column) -> Column:
    """Whether a short text holds a valid match of a strict pattern."""
    found = F.regexp_extract_all(_VIEWS[kind](match), F.lit(_STRICT[kind]), F.lit(0))
    return F.exists(found, lambda m: _valid(kind, m))


def _covered(text: Column, kind: str, marks: bool) -> Column:
    """The text with marks around the known spans of a kind, or a blank for each of their characters.

    The marked form drops the plus sign of telephone numbers, since strict patterns decide by it, and appends each once more with
    another one beside it that has no country code, so that spans across two numbers are seen.
    """
    pattern, seen = (_DATE, text) if kind == "date" else (_STRICT[kind], _VIEWS[kind](text))
    if kind == "card":
        seen = F.regexp_replace(F.regexp_replace(text, "(?<=[0-9]) (?=[0-9])", _JOIN), "(?<=[0-9])-(?=[0-9])", _HYPHEN)
        pattern = f"[0-9][0-9{_JOIN}{_HYPHEN}]+"

    def cover(match: Column) -> Column:
        if not marks or kind not in _OPEN:
            return F.repeat(F.lit(_BLANK), F.length(match))
        if kind != "phone":
            return F.concat(F.lit(_OPEN[kind]), match, F.lit(_CLOSE))
        bare = F.regexp_replace(match, r"^\+", "")
        beside = F.regexp_replace(bare, r"^[0-9]+[ ().-]*", "")
        return F.concat(F.lit(_OPEN[kind]), bare, F.lit(_CLOSE), F.lit(_PAIR), bare, F.lit(" "), beside, F.lit(_CLOSE))

    def known(match: Column) -> Column:
        return F.lit(True) if kind == "date" else _valid(kind, match)

    parts = F.transform(
        _pieces(seen, pattern),
        lambda p: F.concat(p["gap"], F.when(p["match"].isNull(), "").when(known(p["match"]), cover(p["match"])).otherwise(p["match"])),
    )
    back = F.translate(F.array_join(parts, ""), _JOIN + _HYPHEN + _DOT, " -.")
    return F.when(text.rlike("[0-9][-./][0-9]" if kind == "date" else _HINTS[kind]), back).otherwise(text)


def _groups(pieces: Column) -> Column:
    """The groups of digits of a text: their place and digits, what stands around them, where their run of groups begins."""
    after = F.concat(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.left(p["gap"], F.lit(3))), F.array(F.lit("")))
    linked = F.transform(pieces, lambda p, i: (i > 0) & p["gap"].rlike(r"^[ ().-]+$"))
    first = _running(F.zip_with(linked, F.transform(pieces, lambda p, i: i), lambda link, i: F.when(link, 0).otherwise(i)), F.greatest)
    digits = _running(F.transform(pieces, lambda p: F.coalesce(F.length(p["match"]), F.lit(0))), lambda a, b: a + b)
    numbers = F.arrays_zip(
        pieces.alias("piece"), _ends(pieces).alias("end"), after.alias("after"), linked.alias("linked"), first.alias("first"), digits.alias("digits")
    )
    return F.filter(
        F.transform(
            numbers,
            lambda g: F.struct(
                g["piece"]["match"].alias("match"), F.when(g["linked"], g["piece"]["gap"]).otherwise("").alias("gap"),
                F.right(g["piece"]["gap"], F.lit(32)).alias("tail"), g["after"].alias("after"), g["end"].alias("end"),
                g["first"].cast("int").alias("first"), g["digits"].alias("digits"),
            ),
        ),
        lambda g: g["match"].isNotNull(),
    )


def _windows(groups: Column) -> Column:
    """All spans from one group of digits to another of its run that have a plausible number of digits."""
    least = min(low for low, _ in _SIZES.values())

    def of(group: Column, i: Column) -> Column:
        before = group["digits"] - F.length(group["match"])
        last = F.least(i + _MOST_DIGITS - 1, F.size(groups) - 1)
        ends = F.filter(
            F.sequence(i, last),
            lambda j: (F.get(groups, j)["first"] == group["first"]) & (F.get(groups, j)["digits"] - before).between(least, _MOST_DIGITS),
        )
        lead = F.right(group["tail"], F.lit(1))
        bracket = F.when(lead == "(", "(").otherwise("")
        head = F.get(groups, group["first"])["tail"]
        run = F.filter(F.slice(groups, group["first"] + 1, 2 * _MOST_DIGITS), lambda g: g["first"] == group["first"])
        bare = F.regexp_replace(group["tail"], f"[+({_MARKS}]+$", "")

        def window(j: Column) -> Column:
            end = F.get(groups, j)
            inner = F.transform(F.slice(groups, i + 2, j - i), lambda g: F.concat(g["gap"], g["match"]))
            return F.struct(
                F.concat(bracket, group["match"], F.array_join(inner, "")).alias("match"),
                F.right(bare, F.lit(1)).alias("before"),
                F.left(F.regexp_replace(end["after"], f"^[{_MARKS}]+", ""), F.lit(1)).alias("after"),
                (group["end"] - F.length(group["match"]) - F.when(lead.isin("+", "("), 1).otherwise(0)).alias("start"),
                end["end"].alias("end"),
                (i - group["first"]).alias("nth"),
                (F.coalesce(F.get(groups, j + 1)["first"], F.lit(-1)) == group["first"]).alias("goes_on"),
                (j - i + 1).alias("count"),
                F.right(head, F.lit(1)).alias("mark"),
                F.when(F.right(head, F.lit(1)) == _PAIR, F.size(run)).alias("run"),
                F.lower(F.regexp_extract(head, r"(\p{L}+)\W{0,3}$", 1)).alias("word"),
            )

        return F.transform(ends, window)

    return F.flatten(F.transform(groups, of))


def _label(s: Column, kind: str) -> Column:
    """Whether a candidate is one of the kind, or null if that is not known."""
    match = s["match"]
    if kind == "email":
        none = ~match.rlike(r"@[^@]*[.,]") | ~match.rlike(r"[\p{L}0-9]@[\p{L}0-9]")
        return F.when(_holds(kind, match), True).when(none, False)
    if kind == "ip":
        listed = match.rlike(r"^[0-9]+(?:,[0-9]{3}){3}$") | ~match.rlike(r"^[0-9]+([.,:])[0-9]+\1[0-9]+\1[0-9]+$")
        listed = listed | s["before"].isin(",", ":") | (s["after"].isin(",", ":") & ~match.contains("."))
        far = F.exists(F.split(match, "[.,:]"), lambda p: p.cast("int") > 255)
        return F.when(_holds(kind, match), True).when(listed | far, False)
    alone, known = (s["nth"] == 0) & ~s["goes_on"], s["mark"].isin(_PAIR, *_OPEN.values())
    label = F.when(s["mark"] == _OPEN[kind], alone)
    if kind == "phone":
        one = F.floor((s["run"] + 1) / 2)
        own = (s["count"] == one) & (s["nth"] == 0) | (s["count"] == one - 1) & s["nth"].isin(1, one)
        label = F.when(s["mark"] == _PAIR, own).when(s["mark"] == _OPEN[kind], alone | ((s["nth"] == 1) & ~s["goes_on"]))
    none = s["before"].rlike("[\\p{L}_]") | s["after"].rlike("[\\p{L}_]") | s["word"].isin(*_ITEM_WORDS)
    none = none | match.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$")
    if kind == "card":
        none = none | ~_luhn(match)
    return label.when(known, False).when(none, False)


def _candidates(found: Column, kind: str, labels: bool) -> Column:
    """Candidates of a kind with their features, and their labels or whether they hold no base span."""
    match, number = "match", F.lit(float(KINDS.index(kind)))
    word = "[A-Za-z0-9]"
    windows = kind in _SIZES

    def features(s: Column) -> Column:
        # Numbers are told by their groups, since the same one is spelled with brackets, dots, hyphens or spaces.
        shape = F.regexp_replace(s[match], "[^0-9]+(?=[0-9])", "-") if windows else s[match]
        shape = F.regexp_replace(shape, "^-", "") if windows else shape
        values = [
            number,
            F.length(shape),
            F.length(_digits(shape)),
            F.length(F.regexp_replace(shape, "[A-Za-z0-9]", "")),
            F.length(F.regexp_replace(shape, "[^()]", "")),
            F.length(F.regexp_replace(shape, "[^.]", "")),
            F.length(F.regexp_extract(shape, "^[^0-9]*([0-9]*)", 1)),
            F.length(F.regexp_extract(shape, "([0-9]*)$", 1)),
            F.length(F.regexp_extract(shape, "([A-Za-z]*)$", 1)),
            s["before"].rlike(word).cast("int"),
            s["after"].rlike(word).cast("int"),
            s["before"].rlike("[=:\"']").cast("int"),
            F.coalesce(F.regexp_extract(s[match], "([0-9])", 1).try_cast("int"), F.lit(-1)),
            (s["nth"] > 0).cast("int") if windows else F.lit(0),
            s["goes_on"].cast("int") if windows else F.lit(0),
        ]
        if labels:
            more = [_label(s, kind).cast("double").alias("label")]
        else:
            base = F.lit(False) if windows else F.exists(F.array(*(_holds(k, s[match]) for k in KINDS)), lambda x: x)
            more = [s["start"].alias("start"), s["end"].alias("end"), base.alias("base")]
        return F.struct(*more, *(v.cast("double").alias(n) for v, n in zip(values, _FEATURES)))

    if windows:
        found = F.filter(found, lambda s: F.length(_digits(s[match])).between(*_SIZES[kind]))
    return F.transform(found, features)


def _with_spans(df: DataFrame, text: Column, patterns: dict[str, str], views: dict, prefix: str) -> DataFrame:
    """Adds an array of spans for each pattern."""
    for name, pattern in patterns.items():
        seen = views.get(name, lambda t: t)(text)
        pieces = F.when(text.rlike(_HINTS[name]), _pieces(seen, pattern))
        df = df.withColumn(f"{prefix}{name}_pieces", pieces)
    for name in patterns:
        pieces = F.col(f"{prefix}{name}_pieces")
        df = df.withColumn(f"{prefix}{name}", F.when(F.size(pieces) > 1, _spans(pieces)).otherwise(F.array()))
    return df.drop(*(f"{prefix}{name}_pieces" for name in patterns))


def _with_candidates(df: DataFrame, text: Column, prefix: str, labels: bool = False) -> DataFrame:
    """Adds the candidates of each kind; those of numbers do not overlap base spans, except for labels, where they lie inside."""
    df = _with_spans(df, text, _WIDE, {}, f"{prefix}wide_")
    free = F.col(f"{prefix}free")  # Each step names the one before once, by `bind`: a filter on the results copies all of them.
    df = df.withColumn(f"{prefix}free", F.translate(text, _MARKS + _JOIN + _HYPHEN + _DOT, _OTHER * (len(_MARKS) + 3)))
    for kind in ("phone", "card", "ip", "email", "date"):
        df = df.withColumn(f"{prefix}free", bind(free, lambda t: _covered(t, kind, labels)))
    df = df.withColumn(f"{prefix}pieces", bind(free, lambda t: F.when(t.rlike("[0-9][ ().-]*[0-9]"), _pieces(t, "[0-9]+"))))
    df = df.withColumn(f"{prefix}groups", bind(F.col(f"{prefix}pieces"), lambda p: F.when(F.size(p) > 1, _groups(p))))
    df = df.withColumn(f"{prefix}wide_number", F.coalesce(bind(F.col(f"{prefix}groups"), _windows), F.array()))
    sources = {"email": "email", "ip": "ip", "card": "number", "phone": "number"}
    return df.withColumns({f"{prefix}candidates_{k}": _candidates(F.col(f"{prefix}wide_{sources[k]}"), k, labels) for k in KINDS})


def _tree(lines: list[str], at: int, read) -> tuple[Column, int]:
    """A tree as nested conditions, from its printed form."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1])), at + 1
    feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left, at = _tree(lines, at + 1, read)
    right, at = _tree(lines, at + 1, read)
    return F.when(read(_FEATURES[int(feature)]) <= float(limit), left).otherwise(right), at


@dataclass(frozen=True)
class SpanModel:
    """Kinds and weights of printed trees, and the smallest probability of a span to add by kind (above 1: none)."""

    trees: tuple[tuple[str, float, str], ...] = ()
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(KINDS, 2.0))

    def probability(self, kind: str, read) -> Column:
        margin = F.lit(0.0)
        for weight, printed in ((w, p) for k, w, p in self.trees if k == kind):
            lines = [x for x in printed.splitlines()[1:] if x.strip()]
            margin = margin + F.lit(weight) * _tree(lines, 0, read)[0]
        return F.round(1 / (1 + F.exp(-2 * margin)), 3)


def labelled(df: DataFrame, text_col: str = "text", seed: int = 1) -> DataFrame:
    """How many labelled candidates of all rows have the same features, apart for the texts that train (`fitting`) and the others."""
    rows = _with_candidates(df.select(whole(f"`{text_col}`").alias("text")), F.col("text"), "", labels=True)
    every = F.filter(F.concat(*(F.col(f"candidates_{k}") for k in KINDS)), lambda c: c["label"].isNotNull())
    fitting = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(2)) == 0
    rows = rows.select(fitting.alias("fitting"), F.inline(every))
    return rows.groupBy("fitting", "label", *_FEATURES).agg(F.count(F.lit(1)).alias("n"))


def train(df: DataFrame, text_col: str = "text", precision: float = PRECISION, trees: int = 12, depth: int = 3, seed: int = 1) -> SpanModel:
    """A model of the labelled candidates of all texts; null texts have none.

    Half of the texts, by a hash, train, the others set the thresholds. A kind without positive or without negative candidates
    in either half gets no trees, and nothing is added to its base spans.
    """
    rows = written(labelled(df, text_col, seed), "candidates")
    counts = {(r["fitting"], r["kind"], r["label"]) for r in rows.select("fitting", "kind", "label").distinct().collect()}
    grown, thresholds = (), dict.fromkeys(KINDS, 2.0)
    for number, kind in enumerate(KINDS):
        if not all((half, float(number), label) in counts for half in (True, False) for label in (0.0, 1.0)):
            continue
        own = rows.where(F.col("kind") == number)
        vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(own.where("fitting"))
        vectors = vectors.withColumn("weight", F.col("n").cast("double"))
        boosted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", weightCol="weight").fit(vectors)
        grown += tuple((kind, float(w), t.toDebugString) for w, t in zip(boosted.treeWeights, boosted.trees))
        scored = own.where("not fitting").withColumn("p", SpanModel(grown).probability(kind, F.col))
        steps = scored.groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits")).collect()
        above = hits = 0
        for step in sorted(steps, key=lambda s: -s["p"]):
            above, hits = above + step["n"], hits + step["hits"]
            if hits >= CALIBRATION_CANDIDATES and hits >= precision * above and step["p"] >= 0.5:
                thresholds[kind] = step["p"]
    return SpanModel(grown, thresholds)


_RANKED = "array<struct<rank:double,size:bigint,start:bigint,end:bigint,kind:string>>"


def _reaching(candidates: Column, model: SpanModel, kind: str) -> Column:
    """Candidates without any base span inside that reach the threshold, the best first when sorted."""
    if model.thresholds[kind] > 1:
        return F.array().cast(_RANKED)
    open_ = F.filter(candidates, lambda c: ~c["base"])
    ranked = F.transform(
        open_,
        lambda c: F.struct(
            (-model.probability(kind, lambda name: c[name])).alias("rank"), (c["start"] - c["end"]).alias("size"), c["start"].alias("start"),
            c["end"].alias("end"), F.lit(kind).alias("kind"),
        ),
    )
    return F.filter(ranked, lambda c: c["rank"] <= -model.thresholds[kind]).cast(_RANKED)


def _chosen(ranked: Column, base: Column) -> Column:
    """Of overlapping spans the best one; none that overlaps a base span."""

    def apart(c: Column, others: Column) -> Column:
        return ~F.exists(others, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))

    free = F.filter(ranked, lambda c: apart(c, base))
    return F.aggregate(F.array_sort(free), F.array().cast(_RANKED), lambda a, c: F.when(apart(c, a), F.concat(a, F.array(c))).otherwise(a))


def find_spans(df: DataFrame, model: SpanModel | None = None, text_col: str = "text", into: tuple[str, str] = ("base", "added")) -> DataFrame:
    """The input with two structs of one array of spans (start, end) for each kind: those of the strict patterns, and those the
    model adds.

    Offsets count code points, the end exclusive; each array is in order of start. Null and empty texts have none.
    Added spans overlap neither base spans nor each other. Input columns called as the structs are
    replaced. Every row is searched by itself, so repeated rows, ties and empty tables need no rule.
    """
    base, added = into
    kept = [c for c in df.columns if c not in into]
    prefix = fresh("_pii_", df)
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    text = F.col(f"{prefix}text")
    out = df.withColumn(f"{prefix}text", whole(f"`{text_col}`"))
    out = _with_spans(out, text, _STRICT, _VIEWS, prefix)
    pair = "array<struct<start:bigint,end:bigint>>"
    valid = {}
    for kind in KINDS:
        valid[kind] = _confirmed(F.col(f"{prefix}{kind}"), kind).cast(pair)
    more = {kind: F.array().cast(pair) for kind in KINDS}
    if model and min(model.thresholds.values()) <= 1:
        out = out.withColumn(f"{prefix}base", F.concat(*valid.values()))
        out = _with_candidates(out, text, prefix)
        ranked = F.concat(*(_reaching(F.col(f"{prefix}candidates_{k}"), model, k) for k in KINDS))
        out = out.withColumn(f"{prefix}ranked", ranked)
        chosen = bind(F.col(f"{prefix}ranked"), lambda r: F.when(F.size(r) > 0, _chosen(r, F.col(f"{prefix}base"))).otherwise(F.array().cast(_RANKED)))
        out = out.withColumn(f"{prefix}chosen", chosen)
        for k in KINDS:
            own = F.filter(F.col(f"{prefix}chosen"), lambda c: c["kind"] == k)
            more[k] = F.array_sort(F.transform(own, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))).cast(pair)
    columns = [F.col(f"`{c}`") for c in kept]
    return out.select(*columns, F.struct(*(valid[k].alias(k) for k in KINDS)).alias(base), F.struct(*(more[k].alias(k) for k in KINDS)).alias(added))


def _written_out(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def personal_data(df: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """The input with the number of base spans of each kind, the digest of the base spans, and all spans as
    kind:start:end, by kind and start, joined by commas. Input columns with the name of a result are replaced."""
    base, added = fresh("base", df), fresh("added", df)
    found = find_spans(df, model, text_col, (base, added))
    own = [_written_out(F.col(base)[k], k) for k in KINDS]
    all_ = [_written_out(F.array_sort(F.concat(F.col(base)[k], F.col(added)[k])), k) for k in KINDS]
    results = F.struct(
        *(F.size(F.col(base)[k]).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*own), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*all_), ",").alias("spans"),
    )
    return with_results(found, results, RESULTS).drop(base, added)


def redacted(text: str | Column, spans: Column, mark: str = "[removed]") -> Column:
    """A text with its spans (start, end; of any kind, overlapping or not) replaced."""
    column = whole(text)
    sorted_ = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(
        sorted_,
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(a["parts"], F.array(F.concat(F.substr(column, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))),
            ).otherwise(a["parts"]).alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(column, (a["at"] + 1).cast("int"))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(column)
