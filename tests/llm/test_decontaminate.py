"""FM-index and decontamination against brute force."""

import re

import numpy as np
import pytest

from astrolake.llm import decontaminate, fmindex

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_index_equals_scanning():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        symbols = rng.integers(0, rng.integers(2, 6), n)
        symbols[-1] = 0
        names = np.where(symbols == 0, np.cumsum(symbols == 0) - 1, symbols + (symbols == 0).sum())
        order = sorted(range(n), key=lambda i: names[i:].tolist())
        assert fmindex.suffix_array(symbols).tolist() == order
        index = fmindex.FMIndex(symbols, 6, rate=4)
        patterns = rng.integers(1, 6, (6, 3))
        patterns[:2, 0] = -1
        begin, end = index.search(patterns)
        for pattern, lo, hi in zip(patterns, begin, end):
            pattern = pattern[pattern >= 0]
            got = sorted(index.locate(np.arange(lo, hi)).tolist()) if hi > lo else []
            assert got == [i for i in range(n - len(pattern) + 1)
                           if (symbols[i:i + len(pattern)] == pattern).all()]


def expected(text, items, window=10):
    spans = [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
    words = [text.translate(LOWER)[a:b] for a, b in spans]
    hit, met = set(), set()
    for item, said in items:
        wanted = WORD.findall((said or "").translate(LOWER))
        size = min(window, len(wanted))
        for at in range(len(wanted) - size + 1 if size else 0):
            for place in range(len(words) - size + 1):
                if words[place:place + size] == wanted[at:at + size]:
                    hit.update(range(place, place + size))
                    met.add("" if item is None else str(item))
    return len(words), len(hit), sorted(met)


P = " ".join(f"w{i}" for i in range(14))
ITEMS = [(10, P), (9, "Short ONE"), (2, P.upper()), (None, "ünï code"), (3, ""), (4, None), (5, "..."),
         (6, "a b a b a b a b a b a b")]
DOCS = [None, "", "...", P, f"x {P} y", "w1 w2 w3", "say short one, then short-one!", "ÜNÏ code ünï  code",
        "a b " * 30, P.replace(" ", "\n") + " tail", f"{P} {P}", "w0 " + P, "😀 " + P + " 😀 end",
        ("filler words here " * 400) + P + (" more filler" * 300)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_equals_brute_force_in_one_or_several_passes(spark, block_bytes):
    rows = [(at, text, "n", 5) for at, text in enumerate(DOCS)] + [(3, DOCS[3], "n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string, _text int")
    bench = spark.createDataFrame([(a, b, "x") for a, b in ITEMS], "item_id long, text string, words string")
    found = decontaminate.contaminated_spans(
        df, "text", bench, "item_id", "text", block_bytes=block_bytes).collect()
    assert len(found) == len(rows)
    for row in found:
        assert (row.n_words, row.n_hit, row["items"]) == expected(row.text, ITEMS), row.doc_id
        for span in row.spans:
            part = row.text[span.start:span.end]
            assert len(WORD.findall(part.translate(LOWER))) == span.end_word - span.first_word


def test_long_stretches_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(3)
    bench = [(n, " ".join(map(str, rng.integers(0, 3, 12)))) for n in range(20)]
    table = __import__("pyarrow").table({
        "item": [str(n) for n, said in bench for at in range(3)],
        "words": [said.split()[at:at + 10] for n, said in bench for at in range(3)]})
    wanted = decontaminate.Passages(table)
    text = " ".join(map(str, rng.integers(0, 3, 30_000)))
    numbers = decontaminate.WORDS.numbers(
        text.encode(), wanted.vocabulary.get, __import__("itertools").repeat(0))
    bounds = np.array([len(numbers)])
    whole = set(zip(*decontaminate.occurrences(numbers, bounds, wanted)))
    cut = set(zip(*decontaminate.occurrences(numbers, bounds, wanted, shard_words=500)))
    assert whole and whole == cut


def test_empty_benchmark_and_removal(spark):
    df = spark.createDataFrame([(1, f"keep {P} this"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, P)], "item_id long, text string")
    none = decontaminate.contaminated_spans(df, "text", bench.limit(0), "item_id", "text").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in none] == [(16, 0, []), (0, 0, [])]
    found = decontaminate.contaminated_spans(df, "text", bench, "item_id", "text")
    left = found.select(decontaminate.without_spans(
        decontaminate.F.col("text"), decontaminate.F.col("spans")).alias("t")).collect()
    assert [r.t for r in left][0] == "keep  this"
    assert decontaminate.contaminated_spans(df.limit(0), "text", bench, "item_id", "text").count() == 0
