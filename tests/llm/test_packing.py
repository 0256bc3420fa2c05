"""Packing: ids as the public library gives them, every id in one place, the curve."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from astrolake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, texts, length=1024):
    """Pieces rebuild every document, and sequences are gapless and full but for the last."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for piece in pieces:
        by_doc[piece.doc_id].append(piece)
        by_sequence[piece.sequence_id].append(piece)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for piece in sorted(by_doc[doc], key=lambda p: p.start):
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert np.frombuffer(bytes(piece.ids), "<u4").tolist() == ids[at:at + piece.length]
            at += piece.length
        assert at == len(ids)
    for sequence, members in by_sequence.items():
        at = 0
        for piece in sorted(members, key=lambda p: p.offset):
            assert piece.offset == at
            at += piece.length
        assert at == length or sequence == max(by_sequence) and at < length
    assert set(by_sequence) == set(range(len(by_sequence)))


def test_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    check(packing.pack(documents, "doc_id", "text", PATH).collect(), texts)
    check(packing.pack(documents, "doc_id", "text", PATH, length=64).collect(), texts, 64)


def test_nulls_empty_texts_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "x" * 5000), (4, "<|endoftext|> a<|endoftext|>b"), (5, "same"), (6, "same")]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, _n int")
    check(packing.pack(df, "doc_id", "text", PATH, length=16).collect(), dict(rows), 16)
    both = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    pieces = packing.pack(both, "doc_id", "text", PATH).collect()
    assert sorted(p.offset for p in pieces) == [0, 3, 6] and len(pieces) == 3
    assert packing.pack(df.limit(0), "doc_id", "text", PATH).collect() == []


def test_hilbert_neighbours_are_neighbouring_cells():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[range(side)] * dimensions)).reshape(dimensions, -1).T
        key = packing.hilbert_key(cells, bits)
        assert sorted(key) == list(range(side ** dimensions))
        steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_neighbours_in_the_stream_are_alike(spark):
    """Documents of one language have similar vectors, so they follow each other more often than in
    the order of ids."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    language = {r.doc_id: r.lang for r in documents.collect()}
    pieces = packing.pack(documents, "doc_id", "text", PATH).where("start = 0").collect()
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]

    def changes(ids):
        return sum(language[a] != language[b] for a, b in zip(ids, ids[1:]))

    assert changes(order) < 0.5 * changes(sorted(order))


def test_new_words_share_calls(monkeypatch):
    """The model gets many new words in one call; ids and lengths stay those of each word alone."""
    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(packing, "_TABLES", {})
    words = [" the", "<|endoftext|>", " ", "x" * 3000, "\n\n", "\x85", "<|endoftext|>", " ", "né", "a"]
    ids, lengths = packing._words(PATH, public_tokenizers.PATTERN).encode_words([w.encode() for w in words])
    expected = [tokenizer.encode(word, add_special_tokens=False).ids for word in words]
    assert lengths.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [x for word in expected for x in word]
    empty = packing._words(PATH, public_tokenizers.PATTERN).encode_words([])
    assert [len(x) for x in empty] == [0, 0]
