"""Registered queries without SQL against the public libraries: digests, hex forms, sums."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

from astrolake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1_digests(spark):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in QUERIES["op1_bpe_round_trip"](spark, FOLDER).collect()}
    documents = texts(spark)
    assert set(found) == set(documents)
    for number, text in documents.items():
        ids = encoding.encode_ordinary(text)
        row = found[number]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def test_op8_fingerprints_and_components(spark):
    found = {r.doc_id: r for r in QUERIES["op8_simhash_near_dedup"](spark, FOLDER).collect()}
    prints = {}
    for number, text in texts(spark).items():
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[number] = sum(
            1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    root = {number: number for number in prints}

    def top(number):
        while root[number] != number:
            number = root[number]
        return number

    numbers = sorted(prints)
    for at, a in enumerate(numbers):
        for b in numbers[:at]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    assert {n: (r.fingerprint, r.component_id) for n, r in found.items()} == {
        n: (f"{prints[n]:016x}", top(n)) for n in numbers}


def test_op9_rows(spark):
    rows = QUERIES["op9_language_id"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts(spark))
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.lang_pred


def test_op10_pieces(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {number: tokenizer.encode(text, add_special_tokens=False).ids + [0]
           for number, text in texts(spark).items()}
    covered = dict.fromkeys(ids, 0)
    for piece in QUERIES["op10_hilbert_packing"](spark, FOLDER).collect():
        some = ids[piece.doc_id][piece.start:piece.start + piece.length]
        assert len(some) == piece.length and piece.doc_tokens == len(ids[piece.doc_id])
        assert piece.ids_crc32 == zlib.crc32(np.array(some, "<u4").tobytes())
        assert piece.offset + piece.length <= 1024
        covered[piece.doc_id] += piece.length
    assert covered == {number: len(values) for number, values in ids.items()}
