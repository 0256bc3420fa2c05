"""Tokenizer alignment against both public libraries and a plain merge of their ends."""

import bisect
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from astrolake.llm import alignment
from astrolake.llm.packing import byte_alphabet
from astrolake.llm.queries import QUERIES

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b   c\n\n d "), (5, "x▁y z ▁ q"), (7, "=" * 3000),
    (6, "<|endoftext|> </s> <0x41>"), (8, "日本語 のテ キスト 😀😀 ok " * 30), (9, "ab " * 3000),
    (10, "\x00\x01 \t x"), (11, " lead"), (12, "trail "), (13, "same text"), (14, "same text"),
]


def expected(rows):
    """Sums of every document, token by token."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {shown: byte for byte, shown in byte_alphabet().items()}
    found, holding = [], Counter()
    for _, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        of_a = [bytes(back[c] for c in tokenizer.id_to_token(i)) for i in a]
        of_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        said = (" " + text).encode() if text else b""
        if not text or b"".join(of_a) != said or b"".join(of_b) != said:
            found.append(None)
            continue
        ends = []
        for side in (of_a, of_b):
            total, stops = 0, []
            for token in side:
                total += len(token)
                stops.append(total)
            ends.append(stops)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, (ids, stops) in enumerate(zip((a, b), ends)):
            for token, stop in zip(ids, stops):
                groups[bisect.bisect_left(cuts, stop)][side].append(token)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        holding.update(links.keys())
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        found.append((a, b, groups, links, hashlib.sha256(written.encode()).hexdigest()))
    best = Counter()
    for (left, _), n in holding.items():
        best[left] = max(best[left], n)
    out = {}
    for (number, _), one in zip(rows, found):
        if one is None:
            out[number] = (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links, digest = one
        out[number] = (
            len(a), len(b), len(groups), links.total(),
            sum(n for pair, n in links.items() if holding[pair] == best[pair[0]]),
            sum(n * holding[pair] for pair, n in links.items()), digest)
    return out


def sums(df):
    return {row[0]: tuple(row[name] for name in SUMS) for row in df.collect()}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text").collect()]
    assert sums(QUERIES["op12_tokenizer_alignment"](spark, folder)) == expected(rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_texts_in_one_or_several_slices(spark, parts):
    df = spark.createDataFrame([(a, b, 7, 8) for a, b in ODD],
                               "doc_id long, text string, t int, n_a int").repartition(parts)
    found = alignment.align(df, "text", A, B)
    assert found.columns[:3] == ["doc_id", "text", "t"]
    assert sums(found) == expected(ODD)
    assert alignment.align(df.limit(0), "text", A, B).collect() == []


def test_long_texts_are_cut_and_long_groups_counted(monkeypatch):
    for name, value in (("PART_CHARS", 40), ("CHUNK_CHARS", 200), ("LANE_TOKENS", 8), ("EXPANDED", 3)):
        monkeypatch.setattr(alignment, name, value)
    aligner = alignment.Aligner(A, B, public_tokenizers.PATTERN)
    texts = [text or "" for _, text in ODD]
    found = alignment._Sums(aligner, texts)
    for at, (number, want) in enumerate(expected(ODD).items()):
        assert (*found.sums[:, at], found.digests[at]) == (*want[:4], want[6]), number
        assert found.times[found.document == at].sum() == want[3]


def test_groups_and_pairs(spark):
    df = spark.createDataFrame([(1, "are  are"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.groups for r in alignment.aligned_groups(df, "text", A, B).collect()}
    assert rows[2] == [] and len(rows[1]) >= 2
    job = alignment.Alignment(df, "text", A, B)
    pairs = {(r.a, r.b): r.n for r in job.pairs().collect()}
    assert set(pairs) == {(x, y) for g in rows[1] for x in g.a for y in g.b}
    assert set(pairs.values()) == {1}
    job.drop()
