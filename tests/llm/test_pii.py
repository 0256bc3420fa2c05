"""Personal data: patterns against plain regular expressions, segmentations against enumeration."""

import random
import re
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from astrolake.llm import pii


def plain(text):
    """The patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda span: (span[0], pii.RANK[span[2]]))


@pytest.fixture(scope="module")
def texts():
    return pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()


@pytest.fixture(scope="module")
def model(texts):
    return pii.fit([t for t in texts if re.search("[0-9@]", t)])


def test_patterns(texts):
    rng = random.Random(3)
    parts = ["1", "2", "55", "@", "a", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "%",
             "255", "x.y", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain(text), text
    for text in texts:
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1(" * 100_000, "@" * 300_000,
                 "a.1@" * 50_000):
        pii.base_spans(text)
        pii.clusters(text)


def test_best_segmentation_equals_enumeration():
    rng = np.random.default_rng(1)
    for text in ("12345", "+1 (98) 55", "a@b.c 1234", "1.2.3.4 12"):
        model = pii.Model()
        model.weights = rng.standard_normal(model.weights.shape)
        model.moves = rng.standard_normal(model.moves.shape)
        cluster = pii.clusters(text)[0]
        n = len(cluster.tokens)
        scores = {(i, j): model.score(f) for i, j, f in pii.candidates(text, cluster)}
        best, chosen = -1e9, None
        for cuts in product((0, 1), repeat=n - 1):
            bounds = [0, *(i + 1 for i, cut in enumerate(cuts) if cut), n]
            segments = list(zip(bounds, bounds[1:]))
            options = [
                ([0] if j == i + 1 else []) +
                [k for k in range(1, 5) if (i, j) in scores and max(scores[i, j]) > 0]
                for i, j in segments
            ]
            for labels in product(*options):
                total, before = 0.0, 0
                for (i, j), label in zip(segments, labels):
                    total += model.moves[before][label] + (scores[i, j][label - 1] if label else 0)
                    before = label
                if total > best:
                    best, chosen = total, [
                        (cluster.tokens[i][0], cluster.tokens[j - 1][1], pii.KINDS[k - 1])
                        for (i, j), k in zip(segments, labels) if k]
        assert model.decode(text, cluster) == chosen


def test_segments_without_a_score_of_their_own_stay_in_the_search():
    """The best total over all labellings, segments with scores of at most 0 among them."""
    rng = np.random.default_rng(2)
    carried = 0
    for text in ("12345", "+1 (98) 55", "a@b.c 1234", "1.2.3.4 12") * 5:
        model = pii.Model()
        model.weights = rng.standard_normal(model.weights.shape) - 0.5
        model.moves = 3 * rng.standard_normal(model.moves.shape)
        cluster = pii.clusters(text)[0]
        n = len(cluster.tokens)
        scores = {(i, j): model.score(f) for i, j, f in pii.candidates(text, cluster)}
        best, chosen = -1e9, None
        for cuts in product((0, 1), repeat=n - 1):
            bounds = [0, *(i + 1 for i, cut in enumerate(cuts) if cut), n]
            segments = list(zip(bounds, bounds[1:]))
            options = [
                ([0] if j == i + 1 else []) + [k for k in range(1, 5) if (i, j) in scores]
                for i, j in segments
            ]
            for labels in product(*options):
                total, before = 0.0, 0
                for segment, label in zip(segments, labels):
                    total += model.moves[before][label] + (scores[segment][label - 1] if label else 0)
                    before = label
                if total > best:
                    best, chosen = total, [(s, k) for s, k in zip(segments, labels) if k]
        carried += any(max(scores[s]) <= 0 for s, _ in chosen)
        assert model.decode(text, cluster) == [
            (cluster.tokens[i][0], cluster.tokens[j - 1][1], pii.KINDS[k - 1])
            for (i, j), k in chosen]
    assert carried


def test_model_finds_base_spans_itself_and_more(texts, model):
    found = missed = 0
    for text in texts:
        own = {span for cluster in pii.clusters(text) for span in model.decode(text, cluster)}
        for span in pii.base_spans(text):
            found += span in own
            missed += span not in own
    assert found >= 0.95 * (found + missed) and found > 30
    base, spans = pii.spans_of("call 1 (988) 555-2485 or +1 (988) 555-2485", model)
    assert len(base) == 1 and [s[2] for s in spans] == ["phone", "phone"]
    for clean in ("version 3.0 of 2024-01-02", "GPL 4.0.", "42", "a@b", "chapter 12, page 345"):
        assert pii.spans_of(clean, model) == ([], [])


def test_spans_stay_and_added_ones_do_not_overlap(texts, model):
    for text in texts:
        base, spans = pii.spans_of(text, model)
        assert set(base) <= set(spans)
        for lo, hi, kind in set(spans) - set(base):
            assert all(hi <= a or b <= lo for a, b, _ in base)


def test_find_and_redact(spark, model):
    df = spark.createDataFrame(
        [(1, None, 1), (None, "", 2), (3, "é a.b@c.de 10.0.0.1", 3), (3, "é a.b@c.de 10.0.0.1", 3)],
        "doc_id long, text string, spans int")
    rows = pii.find(df, "text", model).collect()
    assert [[tuple(s) for s in r.base_spans] for r in rows] == \
        [[], [], *2 * [[("email", 2, 10), ("ip", 11, 19)]]]
    redacted = pii.redact(df, "text", model)
    assert redacted.columns == df.columns
    assert [r.text for r in redacted.collect()] == [None, "", *2 * ["é <EMAIL> <IP>"]]
    assert pii.find(df.limit(0), "text", model).collect() == []


def test_training_sample_and_empty_table(spark):
    df = spark.createDataFrame([(None,), ("no data",)], "text string")
    assert pii.spans_of("a.b@c.de", pii.train(df, "text"))[0] == [(0, 8, "email")]
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pii.train(documents, "text", rows=50).weights.any()


def test_training_sample_holds_distinct_texts(spark, monkeypatch):
    """Copies, whatever their hash, take one place of the sample."""
    monkeypatch.setattr(pii, "fit", lambda texts: texts)
    texts = [f"call {i} now" for i in range(40)]
    rows = [(text,) for i, text in enumerate(texts) for _ in range(30 if i % 2 else 1)]
    df = spark.createDataFrame(rows, "text string")
    assert sorted(pii.train(df, "text", rows=100)) == sorted(texts)
    order = [r.text for r in df.distinct().selectExpr("text", "xxhash64(text) AS h")
             .orderBy("h").collect()]
    assert pii.train(df, "text", rows=15) == order[:15]


def test_rare_kinds_stay_among_the_cases():
    rare = ["at 10.0.0.1 now", "pay 4111 1111 1111 1111 now"]
    texts = [f"page {i} of it" for i in range(5000)] + [f"ask a{i}@b.de now" for i in range(900)]
    cases = pii.training_cases(texts + rare)
    drawn = pii.drawn_cases(cases, 500, np.random.default_rng(5))
    kinds = [k for _, _, gold in drawn for k in {k for _, _, k in gold} or {""}]
    assert len(drawn) == 500
    assert kinds.count("ip") == 1 and kinds.count("card") == 2  # the card and its respelling
    assert abs(kinds.count("") - kinds.count("email")) <= 1
    assert len(pii.drawn_cases(cases, len(cases), np.random.default_rng(5))) == len(cases)
