"""Exact top-k search by inner product: exhaustive accumulation, a term at a time.

Vectors are integer rows; a component is a term, its non-zero values are the term's postings.  The
rows are cut into blocks of bounded size.  In a block every query scatters its weighted postings
into a dense array of scores, term by term; a partition selects the best, and the blocks' bests are
merged.  Queries are cut into blocks as well: one task handles one pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolake.session import settled

ROWS = 4096
# Bytes of the queries a task holds.  The rows are copied once for each block of queries, and scores
# are kept for one query at a time, so the blocks of queries are the large ones.
QUERY_BYTES = 32 << 20
# A sum of products must stay below this to be exact in 64 bits.
LARGEST = float(2**62)


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, weights) of the non-zero values of each column."""
    out = []
    for column in rows.T:
        at = np.flatnonzero(column)
        out.append((at, column[at]))
    return out


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id; in that order."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bound)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray,
                 k: int) -> tuple[list[int], list[int], list[int]]:
    """(query, row id, score) of each query's k best rows in a block, its own row left out."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    if not len(rows) or not len(queries):
        return out
    size = float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1]
    if size >= LARGEST:
        raise ValueError("scores exceed 64 bits")
    lists = postings(rows)
    order = np.argsort(ids, kind="stable")
    for query, weights in zip(query_ids.tolist(), queries):
        scores = np.zeros(len(rows), np.int64)
        for term in np.flatnonzero(weights):
            at, values = lists[term]
            scores[at] += weights[term] * values
        own = order[np.searchsorted(ids, query, sorter=order):][:1]
        others = np.arange(len(ids))
        if len(own) and ids[own[0]] == query:
            others = np.delete(others, own[0])
        chosen = others[best_rows(scores[others], ids[others], k)]
        out[0].extend([query] * len(chosen))
        out[1].extend(ids[chosen].tolist())
        out[2].extend(scores[chosen].tolist())
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def top_k(rows: DataFrame, is_query: Column, k: int, block_rows: int = ROWS,
          block_queries: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, v `array<bigint>`) that `is_query`
    selects: the k largest inner products with other rows, ties to the smaller vec_id.

    `vec_id` must be unique.  Vectors of one length are searched among themselves.  A query without
    other rows of its length gives no row.  Work is queries x rows; each task holds one block of both,
    by default queries of `QUERY_BYTES`.
    """
    rows = settled(rows)
    queries = rows.where(is_query)
    n, m, longest = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    block_queries = block_queries or max(1, QUERY_BYTES // (8 * (longest or 1)))
    row_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))

    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        return df.select("vec_id", "v", F.size("v").alias("size")).withColumn(
            mine, F.pmod(F.xxhash64("vec_id"), F.lit(own))
        ).withColumn(theirs, F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.lit(other - 1).cast("bigint"))))

    kind = dict(rows.dtypes)["vec_id"]
    schema = f"query_id {kind}, vec_id {kind}, score bigint"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search_block(
            left["vec_id"].to_numpy(), _matrix(left["v"]),
            right["vec_id"].to_numpy(), _matrix(right["v"]), k,
        )
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]}, pa.schema([
            ("query_id", left.schema.field("vec_id").type),
            ("vec_id", left.schema.field("vec_id").type), ("score", pa.int64()),
        ]))

    left = dealt(queries, query_blocks, row_blocks, "q", "r").groupBy("size", "q", "r")
    right = dealt(rows, row_blocks, query_blocks, "r", "q").groupBy("size", "q", "r")
    found = left.cogroup(right).applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
