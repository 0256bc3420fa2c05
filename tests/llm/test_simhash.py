"""SimHash and near-duplicate groups against brute force."""

import random

import numpy as np
import xxhash

from astrolake.llm import simhash


def plain_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    if not tokens:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, max_bits):
    """{index: smallest linked index} by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints():
    texts = ["", "  \t\n", "One", "one two", "A b C d e f a b c", "é ü É x y z", None,
             "a\x0bb\x0cc\x1cd e", "x " * 500]
    got = simhash.fingerprint_values([None if t is None else t.encode() for t in texts], 3)
    assert [int(x) for x in got] == [plain_print(t) for t in texts]


def test_links_are_all_pairs_within_the_distance(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 1, 3, (1 << 64) - 1}
    for value in list(values):
        for _ in range(6):
            bits = rng.sample(range(64), rng.randint(1, 4))
            values.add(value ^ sum(1 << b for b in bits))
    values = sorted(signed(v) for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for max_bits, segments in ((2, 2), (2, 3), (3, 2), (0, 2), (1, 4)):
        got = {(r.a, r.b) for r in simhash.links(df, max_bits, segments).collect()}
        want = {(a, b) for a in values for b in values
                if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits}
        assert got == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + \
        [(200, 205), (205, 203), (203, 203)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)},
                   200: 200, 205: 200, 203: 200}
    assert simhash.components(df.limit(0)).collect() == []


def test_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    prints = [plain_print(text) for _, text in rows]
    want = plain_groups(prints, 2)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents, "doc_id", "text").collect()}
    for at, (doc, _) in enumerate(rows):
        assert got[doc].fingerprint == signed(prints[at])
        assert got[doc].component_id == rows[want[at]][0]
    kept = simhash.one_per_group(documents, "doc_id", "text")
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {rows[i][0] for i in set(want)}


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(5, None, "a"), (7, "", "b"), (None, "  ", "c"), (2, "one two three four", "d"),
            (2, "one two three four", "d"), (2, "one two three four", "e"),
            (None, "other words are here", "f"), (None, "other words are here", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = sorted(((r.doc_id, r.component_id) for r in
                  simhash.near_duplicates(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(5, 5), (7, 5), (None, 5), *3 * [(2, 2)], *2 * [(None, None)]], key=str)
    kept = simhash.one_per_group(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == \
        [(0, "other words are here"), (2, "one two three four"), (5, "")]
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").collect() == []
    assert simhash.one_per_group(df.limit(0), "doc_id", "text").collect() == []


def test_hot_group(spark):
    texts = [f"word{i} a b c d e f g h i j k l m n o p q r s t" for i in range(300)]
    rows = [(i, "the same text in many rows") for i in range(700)] + \
        [(1000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups([plain_print(t) for _, t in rows], 2)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    assert got == {doc: rows[want[at]][0] for at, (doc, _) in enumerate(rows)}
    assert np.unique(list(got.values())).size < 300
