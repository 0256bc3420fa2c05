"""Language identification: the recursions, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from astrolake.llm import langid


def plain_posteriors(scores, first, moves, starts):
    """Forward-backward chain by chain, in logarithms."""
    out = []
    begins = [*np.flatnonzero(first), len(scores)]
    for lo, hi in zip(begins, begins[1:]):
        s = scores[lo:hi]
        ahead, back = np.zeros_like(s), np.zeros_like(s)
        ahead[0] = starts + s[0]
        for t in range(1, len(s)):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + moves, axis=0) + s[t]
        for t in range(len(s) - 2, -1, -1):
            back[t] = np.logaddexp.reduce(moves + s[t + 1] + back[t + 1], axis=1)
        both = ahead + back
        out.append(np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]))
    return np.concatenate(out)


def test_chunked_stream_equals_chains_one_by_one():
    rng = np.random.default_rng(0)
    for lengths in ([1], [5, 1, 1, 200, 63, 64, 65], [1000]):
        n = sum(lengths)
        scores = rng.standard_normal((n, 3)) * 4
        first = np.zeros(n, bool)
        first[np.cumsum(lengths) - lengths] = True
        moves, starts = rng.standard_normal((3, 3)), rng.standard_normal(3)
        got = langid.posteriors(scores, first, moves, starts)
        assert np.allclose(got, plain_posteriors(scores, first, moves, starts), atol=1e-9)


def test_expectations_equal_posteriors():
    rng = np.random.default_rng(1)
    scores = rng.standard_normal((4, 10, 3))
    moves, starts = rng.standard_normal((3, 3)), rng.standard_normal(3)
    posterior, pairs = langid._expectations(scores, moves, starts)
    first = np.zeros(40, bool)
    first[::10] = True
    want = plain_posteriors(scores.reshape(40, 3), first, moves, starts)
    assert np.allclose(posterior.reshape(40, 3), want)
    assert np.isclose(pairs.sum(), 4 * 9)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(documents, "doc_id", "text", "lang", per_language=100)
    rows = langid.predict(documents, "text", model).withColumn(
        "held_out", langid.held_out("doc_id")).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == \
        {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # code-switched text: words of both languages are labelled by their own side
    texts = {r.lang: r.text for r in rows if 300 < len(r.text) < 3000}
    mixed = langid.words_of(texts["de"])[:60] + langid.words_of(texts["es"])[:60]
    first = np.zeros(len(mixed), bool)
    first[0] = True
    shares = langid.posteriors(model.scores(mixed), first, model.moves, model.starts)
    labels = [model.languages[i] for i in shares.argmax(axis=1)]
    assert labels[:50].count("de") >= 45 and labels[-50:].count("es") >= 45


def test_edge_cases(spark):
    rows = [(1, "the house is of wood and stone", "en", 1), (2, "das haus ist aus holz", "de", 1),
            (3, None, "en", 1), (4, "", "de", 1), (5, "123 ... !", None, 1), (None, "the", "en", 1),
            (6, "½ ² _ 1a", "en", 1), (6, "½ ² _ 1a", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit([("en", rows[0][1]), ("de", rows[1][1])], sequences=200)
    got = langid.predict(df, "text", model).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "und", "en", *2 * [got[6].lang_pred]]
    assert got[6].lang_pred in ("en", "de") and got[2].score == 0
    nothing = langid.train(df.limit(0), "doc_id", "text", "lang")
    assert nothing.languages == []
    assert {r.lang_pred for r in langid.predict(df, "text", nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), "text", model).collect() == []
    assert [r[0] for r in df.select(langid.held_out("doc_id")).collect()][5] is False


def test_words_without_letters_do_not_count():
    assert langid.words_of("Ça l’été ½ 12 _x y²") == [w for w in ("ça", "l’été", "x", "y²")]


def test_training_sample_holds_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda samples: samples)
    rows = [(i * 1000 + c, f"word {'ab'[i % 2] * (i + 1)}", "en")
            for i in range(40) for c in range(30 if i % 2 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {r.text for r in df.where(~langid.held_out("doc_id")).collect()}
    got = langid.train(df, "doc_id", "text", "lang", per_language=50)
    assert sorted(got) == sorted(("en", text) for text in seen)
    few = langid.train(df, "doc_id", "text", "lang", per_language=10)
    assert len(few) == len(set(few)) == 10


def test_long_labelled_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda samples: samples)
    long = [" ".join(f"{word}{'xyz'[i % 3]}" for i in range(3000)) for word in ("maja", "kirja", "tuli")]
    rows = [(1, "the house", "en"), *((i + 2, text, "fi") for i, text in enumerate(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string") \
        .where(~langid.held_out("doc_id"))
    seen = {r.text for r in df.where("lang = 'fi'").collect()}
    got = [text for language, text in langid.train(df, "doc_id", "text", "lang", max_chars=500)
           if language == "fi"]
    assert seen and len(got) == len(seen)
    assert all(len(text) == 500 and sum(text in whole for whole in seen) == 1 for text in got)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 2 * 400 * 100)
    short = langid.train(df, "doc_id", "text", "lang")
    assert {language for language, _ in short} == {"en", "fi"}
    assert max(len(text) for _, text in short) == 100
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.train(df, "doc_id", "text", "lang")
