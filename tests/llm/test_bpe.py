"""Byte-level BPE against the public library, and exact round trips."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from astrolake.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def table():
    vocabulary = bpe.Vocabulary(bpe.read_ranks(RANKS))
    return bpe.WordTable(public_tokenizers.PATTERN, vocabulary.encode_words), vocabulary


def test_random_and_long_words(reference, table):
    words, vocabulary = table
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "é", "日", "本", "\n", "the", "aaaa", "zz", "1", "'s", " "]
    texts = ["", " ", "<|endoftext|>", "a" * 1000, "ab" * 700, " " * 600, "é" * 300]
    for size in (3, 40, 300, 900):
        for _ in range(40):
            text = "".join(rng.choice(parts) for _ in range(size))
            texts += [text, text.replace(" ", "").replace("\n", "")]
    values, counts = words.encode(texts)
    at = 0
    for text, count in zip(texts, counts):
        ids = values[at:at + count]
        at += count
        assert ids.tolist() == reference(text)
        assert vocabulary.decode(ids).tobytes() == text.encode()


def test_batched_long_merges_equal_single_merges(table):
    _, vocabulary = table
    rng = random.Random(2)
    for _ in range(30):
        word = "".join(rng.choice("abcdeinrst") for _ in range(300)).encode()
        ids = vocabulary.byte_id[list(word)]
        padded = ids[None, :]
        assert vocabulary._merge_long(ids.copy()).tolist() == \
            vocabulary.merge_rows(padded.copy())[0].tolist()


def test_documents_round_trip(spark, reference):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded = bpe.encode(documents, "text", RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == [*documents.columns, "ids"]
    for row in bpe.decode(encoded, "ids", RANKS).collect():
        assert row.ids == reference(row.text)
        assert bytes(row.decoded) == row.text.encode()


def test_nulls_clashing_columns_repeats_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(None, None, "x"), (1, "", None), (1, "hello", "x"), (1, "hello", "x")],
        "doc_id long, text string, ids string")
    rows = bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN).collect()
    assert [r.ids for r in rows] == [[], [], [31373], [31373]]
    assert [r.doc_id for r in rows] == [None, 1, 1, 1]
    none = bpe.encode(df.limit(0), "text", RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(none, "ids", RANKS).collect() == []
    lists = spark.createDataFrame([(None,), ([],), ([31373],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(lists, "ids", RANKS).collect()] == \
        [None, bytearray(), bytearray(b"hello")]


def test_both_splits_agree_on_every_plain_character():
    general, split = bpe.regex.compile(public_tokenizers.PATTERN).findall, \
        bpe.splitter(public_tokenizers.PATTERN)
    plain = 0
    for point in range(0x2100):
        char = chr(point)
        text = f"x{char}y1{char}2  {char} .{char}\n{char}{char}'s {char}_ "
        plain += bpe._OTHER(text) is None
        assert split(text) == general(text), hex(point)
    assert plain > 500


def test_full_word_table_keeps_results(monkeypatch, reference, table):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    _, vocabulary = table
    words = bpe.WordTable(public_tokenizers.PATTERN, vocabulary.encode_words)
    for turn in range(30):
        texts = [f"word{turn * 7 + i} the same number {i} again" for i in range(9)]
        values, counts = words.encode(texts)
        assert values.tolist() == [i for text in texts for i in reference(text)]


def test_the_plain_split_of_every_character():
    """The written-out letters are those of the public pattern, next to each kind of character."""
    general = bpe.regex.compile(public_tokenizers.PATTERN).findall
    plain = bpe._PLAIN[public_tokenizers.PATTERN]
    for number in (*range(0x250), *range(0x2010, 0x2028)):
        text = "".join(f"{a}{chr(number)}{b}" for a in ("a", "1", "!", " ", "'", "\n", "_", " '") for b in ("é", "7", "?", "  ", "s", "ll"))
        if bpe._OTHER(text) is None:
            assert plain(text) == general(text), hex(number)
