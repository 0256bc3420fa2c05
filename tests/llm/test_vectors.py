"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolake.llm import ann, topk, vectors
from astrolake.llm.queries import QUERIES


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{extra}")


def exact(ids, data, every, k):
    out = {}
    for i, query in enumerate(ids):
        if query % every == 0:
            score = data @ data[i]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != query][:k]
            out[int(query)] = [(int(ids[j]), score[j]) for j in order]
    return out


def answers(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found = out.setdefault(row.query_id, [])
        assert row.rank == len(found) + 1
        found.append((row.vec_id, row.score))
    return out


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = rows.select("vec_id", "embedding").collect()
    return rows, np.array([r.vec_id for r in found]), np.array([r.embedding for r in found], float)


def test_exact_top_k(spark, embeddings):
    rows, ids, data = embeddings
    whole = np.floor(256 * data).astype(np.int64)
    used = vectors.usable(rows, "vec_id", "embedding").select(
        "vec_id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))
    for sizes in ({}, {"block_rows": 700, "block_queries": 9}):
        got = answers(topk.top_k(used, F.col("vec_id") % 50 == 0, 5, **sizes))
        assert got == exact(ids, whole, 50, 5)


def test_top_k_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(8)] + [(50, [0.0, 0.0]), (51, [-1.0, 2.0])]
    used = vectors.usable(table(spark, rows), "vec_id", "embedding").select(
        "vec_id", F.col("v").cast("array<bigint>").alias("v"))
    got = answers(topk.top_k(used, F.col("vec_id") % 50 == 0, 5))
    assert got == {0: [(i, 1) for i in range(1, 6)], 50: [(i, 0) for i in range(5)]}
    alone = used.where("vec_id = 0")
    assert topk.top_k(alone, F.col("vec_id") % 50 == 0, 5).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        big = used.select("vec_id", F.transform("v", lambda x: x * 2**40).alias("v"))
        topk.top_k(big, F.col("vec_id") % 50 == 0, 5).collect()


def test_usable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, None, 0), (3, [], 0), (4, [nan, 1.0], 0),
            (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [0.0, 0.0], 0), (8, [1.0], 0),
            (1, [0.5, 2.0], 0), (9, [3.0, 4.0], 0)]
    df = table(spark, rows, ", v int")
    got = {r.vec_id: r.v for r in vectors.usable(df, "vec_id", "embedding").collect()}
    assert got == {1: [0.5, 2.0], 7: [0.0, 0.0], 9: [3.0, 4.0]}
    got = vectors.usable(df, "vec_id", "embedding", zero=False)
    assert {r.vec_id for r in got.collect()} == {1, 9}
    assert vectors.usable(df.limit(0), "vec_id", "embedding").collect() == []


@pytest.mark.parametrize("query", ["op5_ann_search", "op7_exact_top_k"])
def test_mixed_tables_are_errors(spark, tmp_path, query):
    plain = [(i, [float(i + 1), 1.0]) for i in range(60)]
    for name, rows, match in (("lengths", [(60, [1.0])], "several lengths"),
                              ("ids", [(0, [9.0, 9.0])], "several vectors of id 0")):
        if name == "lengths" and query == "op7_exact_top_k":
            continue  # searched by length
        table(spark, plain + rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        with pytest.raises(Exception, match=match):
            QUERIES[query](spark, f"{tmp_path}/{name}").collect()
    table(spark, plain + plain[:1]).write.parquet(f"{tmp_path}/copies/embeddings.parquet")
    asked = {r.query_id for r in QUERIES[query](spark, f"{tmp_path}/copies").collect()}
    assert asked == set(range(0, 60, 20 if query == "op5_ann_search" else 50))


def test_top_k_searches_each_length_and_settles_blocks(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = {n: np.round(rng.standard_normal((80, n)), 2).astype(np.float32) for n in (2, 3, 5)}
    rows = [(3 * i + at, data[n][i].tolist()) for at, n in enumerate(data) for i in range(80)]
    rows += [(300, [1.0]), (301, None), (302, []), (None, [1.0, 2.0]), (350, [float("nan"), 1.0])]
    table(spark, rows + rows[:3]).write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = {}
    for at, n in enumerate(data):
        whole = np.floor(256 * data[n].astype(np.float64)).astype(np.int64)
        expected |= exact(3 * np.arange(80) + at, whole, 50, 5)
    assert answers(QUERIES["op7_exact_top_k"](spark, str(tmp_path))) == expected
    used = vectors.uniform(table(spark, rows), "vec_id", "embedding", mixed=True).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))
    small = topk.top_k(used, F.col("vec_id") % 50 == 0, 5, block_rows=16, block_queries=2)
    assert answers(small) == expected


def test_ann_recall_over_many_leaves(spark, embeddings, monkeypatch):
    rows, ids, data = embeddings
    monkeypatch.setattr(ann, "LEAF_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    got = answers(ann.neighbours(vectors.usable(rows, "vec_id", "embedding", zero=False), 20, 20))
    want = exact(ids, data, 20, 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    scores = {q: dict(zip(ids.tolist(), data @ data[list(ids).index(q)])) for q in list(want)[:20]}
    for query, score in scores.items():
        assert len(got[query]) == 20
        for vec, value in got[query]:
            assert value == pytest.approx(score[vec], abs=1e-12)


def test_ann_copies_norms_and_small_tables(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((60, 8)) * rng.uniform(0.1, 5, (60, 1))
    rows = [(i, data[i].tolist()) for i in range(60)] + [(100 + i, data[3].tolist()) for i in range(60)]
    used = vectors.usable(table(spark, rows), "vec_id", "embedding", zero=False)
    ids = np.array([r[0] for r in rows])
    every = np.array([np.float32(r[1]) for r in rows], float)
    want = exact(ids, every, 20, 20)
    got = answers(ann.neighbours(used, 20, 20))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    few = answers(ann.neighbours(used.where("vec_id < 4"), 2, 20))
    assert {q: len(v) for q, v in few.items()} == {0: 3, 2: 3}
    assert ann.neighbours(used.limit(0), 20, 20).collect() == []


def test_chi_square_bound():
    assert ann.chi_square_bound(2, 0.95) == pytest.approx(5.991, abs=1e-3)
    assert ann.chi_square_bound(12, 0.99) == pytest.approx(26.217, abs=1e-3)


def test_splits_cover_all_points_and_boxes_bound_distances():
    rng = np.random.default_rng(0)
    points = rng.standard_normal((500, 3))
    points[100:300] = points[0]
    tree = ann.Splits(points, 16)
    leaf = tree.leaf(points)
    distance = tree.distances(points)
    assert (distance[np.arange(500), leaf] == 0).all()
    other = rng.standard_normal((50, 3))
    gaps = tree.distances(other)
    for i in range(50):
        assert (gaps[i, leaf] <= ((points - other[i]) ** 2).sum(axis=1) + 1e-9).all()
