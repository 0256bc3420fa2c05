"""Source divergence: small blocks, so that many cells meet, against plain loops."""

import re
from collections import Counter

import pytest

from astrolake.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ROWS = [
    (lang, source, " ".join(f"{word}" for word in words.split() * n))
    for lang in ("en", "fr")
    for source, words, n in (
        ("a", "One two three vier", 3), ("b", "one two two", 2), ("c", "two fünf", 4), ("d", "123 .", 1),
        (None, "one ünf two", 1), ("a", "three three", 2), ("b", None or "x", 1), ("c", "", 1))
] + [(None, "z", None), ("solo", "only", "one one"), ("en", "a", "two " * 5000)]


def expected(rows, min_docs, top):
    docs = [(lang or "", source or "", Counter(
        t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for t in TERM.findall(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        holding, total, groups = Counter(), Counter(), {}
        for _, source, counts in (d for d in docs if d[0] == lang):
            holding.update(counts.keys())
            total.update(counts)
            groups.setdefault(source, Counter()).update(counts)
        kept = sorted(t for t in holding if holding[t] >= min_docs)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def ranked(source, part, values, limit=None):
            order = sorted(values, key=lambda v: (-v[1], v[0].encode()))
            for rank, (item, value) in enumerate(order[:limit], 1):
                out.add((lang, source, part, item, value, rank))

        q, p = shares(total), {source: shares(counts) for source, counts in groups.items()}
        for source in groups:
            ranked(source, "pair", [
                (other, sum((p[source][t] - p[other][t]) ** 2 // (p[source][t] + p[other][t])
                            for t in kept)) for other in groups if other != source])
            ranked(source, "term", [
                (t, (p[source][t] - q[t]) ** 2 // (p[source][t] + q[t]))
                for t in kept if groups[source][t] and p[source][t] > q[t]], top)
    return out


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 2), (1, 3)])
def test_equals_plain_loops_for_any_block_size(spark, blocks):
    df = spark.createDataFrame([(*row, 1, 2) for row in ROWS],
                               "lang string, source string, text string, n int, p long")
    found = divergence.audit(df, "text", "lang", "source", 2, *blocks, top=2)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(ROWS, 2, 2)


def test_no_kept_terms_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "lang string, source string, text string")
    rows = {tuple(r) for r in divergence.audit(df, "text", "lang", "source", 1000).collect()}
    assert rows == expected(ROWS, 1000, 10) and {r[4] for r in rows} == {0}
    assert divergence.audit(df.limit(0), "text", "lang", "source").collect() == []


def test_shares_do_not_overflow(spark):
    big = 10**13
    row = spark.range(1).select(divergence.share(
        divergence.F.lit(big), divergence.F.lit(3 * big), divergence.F.lit(10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (3 * big + 2 * 10**9)


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    text = ("Ab cd1" * 10 + "x" * 50 + " ") * 30
    words = divergence.WORDS
    whole = list(words.parts(text.encode()))
    monkeypatch.setattr("astrolake.llm.words.PART_BYTES", 64)
    parts = list(words.parts(text.encode()))
    assert len(parts) > 5 and [w for p in parts for w in p] == [w for p in whole for w in p]
