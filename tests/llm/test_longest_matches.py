"""Longest verbatim matches of benchmark items and their places, against every pair of places."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from test_text_operators import _WORD, lowered  # noqa: E402

from veilspark.llm import decontamination  # noqa: E402


def longest_matches(text, items, size):
    words, found, longest = _WORD.findall(lowered(text)), set(), 0
    for item, item_text in items:
        theirs = _WORD.findall(lowered(item_text))
        least = min(size, len(theirs))
        for p in range(len(words)):
            for q in range(len(theirs)):
                n = 0
                while p + n < len(words) and q + n < len(theirs) and words[p + n] == theirs[q + n]:
                    n += 1
                longest = max(longest, n if n > 1 or n >= least else 0)
                extended = p and q and words[p - 1] == theirs[q - 1]
                if n >= least > 0 and not extended:
                    found.add((item, q, p, n))
    return longest, found


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
@pytest.mark.parametrize("size", [1, 4])
def test_longest_matches_and_their_places(spark, block_bytes, size):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    items = [(str(i), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(12)]
    items += [("long", passage), ("again", passage[: len(passage) // 2]), (None, "q r s t u"), ("none", None), ("one", "solo")]
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40)))) for i in range(25)]
    docs += [(50, f"x {passage} y"), (51, passage), (52, passage[9:]), (53, f"{passage} {passage}"), (54, None), (55, ""), (56, "Solo q R s T u")]
    docs += [(57, "a b"), (57, "a b")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, found string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_contamination(df, bench, window=size, block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    for row in got:
        longest, found = longest_matches(row.text, items, size)
        assert (row.found.longest, {tuple(m) for m in row.found.matches}) == (longest, found), row.doc_id
        assert len(row.found.matches) == len(found)
        hit = {k for _, _, p, n in found for k in range(p, p + n)}
        assert {k for s in row.found.spans for k in range(s.start, s.end)} == hit
