"""Approximate nearest neighbours by inner product: stable projections in a kd-tree.

The largest inner product becomes the smallest distance by one more coordinate, which gives all rows
the same norm.  A few Gaussian (2-stable) projections keep distances up to a chi-square factor: the
squared projected distance of a pair over its squared distance is chi-square with as many degrees of
freedom as there are projections.

A coarse kd-tree over the projections, fit on a bounded sample, cuts all rows into leaves, and leaves
into blocks of bounded size.  A query first verifies its home leaf, which bounds the distance of its
k-th neighbour.  It then visits every leaf that may still hold a neighbour.  In a block, cells of a
finer kd-tree come in the order of their projected distance, and their rows are verified against the
original vectors, until the stopping test holds: the chance that a row at least this far in the
projection is nearer than the k-th neighbour so far is below 1 - `confidence`.

Equal vectors are folded to one class, with as many of its smallest ids as any answer can use.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.session import settled
from astrolake.operators.ranking import first_within

DIRECTIONS = 12
CONFIDENCE = 0.98
LEAF_ROWS = 2048
MOST_LEAVES = 4096
SAMPLE = 20_000
CELL = 64
QUERY_BLOCK = 16_384


def chi_square_bound(freedom: int, probability: float) -> float:
    """The value a chi-square variable of an even number of degrees stays below with the given
    probability (bisection on the closed form of the distribution)."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1.0 - exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < probability else (lo, mid)
    return hi


def kd_cells(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the cells of a kd-tree: halved at the median of the widest axis until a cell
    has at most `size` rows."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            if len(rows):
                out.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argsort(part[:, axis], kind="stable")
        half = len(rows) // 2
        stack += [rows[order[half:]], rows[order[:half]]]
    return out


class Splits:
    """A coarse kd-tree: an axis and a value per inner node, leaves numbered from the left.

    Fit on a sample, it covers the whole space, so each row has exactly one leaf.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dimensions = sample.shape[1]
        self.nodes: list[tuple[int, float, int, int]] = []  # children: node, or -1 - leaf
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        infinite = np.full(self.dimensions, np.inf)
        self.root = self._build(sample, leaves, -infinite, infinite)

    def _build(self, part: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = part.max(axis=0) - part.min(axis=0) if len(part) > 1 else np.zeros(1)
        if leaves <= 1 or spread.max() == 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        axis = int(np.argmax(spread))
        value = float(np.median(part[:, axis]))
        right = part[:, axis] > value
        if not right.any():
            value = float(part[:, axis][part[:, axis] < value].max())
            right = part[:, axis] > value
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = value
        at = len(self.nodes)
        self.nodes.append((axis, value, 0, 0))
        left = self._build(part[~right], leaves // 2, low, left_high)
        self.nodes[at] = (axis, value, left,
                          self._build(part[right], leaves - leaves // 2, right_low, high))
        return at

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, value, left, right = self.nodes[node]
            above = points[rows, axis] > value
            stack += [(left, rows[~above]), (right, rows[above])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances (points, leaves) to the leaves' boxes."""
        return box_distances(points, np.array(self.low), np.array(self.high))


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        x = points[:, axis, None]
        gap = np.maximum(np.maximum(low[:, axis] - x, x - high[:, axis]), 0.0)
        out += gap * gap
    return out


class Projection:
    """Norm completion and Gaussian directions, from a fixed seed."""

    def __init__(self, dimensions: int, norm: float, directions: int):
        self.square = norm * norm
        self.matrix = np.random.default_rng(3).standard_normal((dimensions + 1, directions))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.square - (vectors * vectors).sum(axis=1), 0.0))
        return vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix[:-1]


def search_block(queries: np.ndarray, projected: np.ndarray, bounds: np.ndarray, rows: np.ndarray,
                 places: np.ndarray, square: float, factor: float, k: int,
                 ) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, scores) of the rows of a block that belong to each query's k best so far.

    `bounds` are the squared distances known to hold k neighbours (infinite if not known).  Cells
    come in order of projected distance; in round r every query still searching verifies its r-th.
    """
    cells = kd_cells(places, CELL)
    low = np.array([places[c].min(axis=0) for c in cells])
    high = np.array([places[c].max(axis=0) for c in cells])
    gaps = box_distances(projected, low, high)
    order = np.argsort(gaps, axis=1, kind="stable")
    squares = (queries * queries).sum(axis=1)
    bounds = bounds.copy()
    best_rows = np.full((len(queries), k), -1, np.int64)
    best = np.full((len(queries), k), -np.inf)
    alive = np.arange(len(queries))
    for turn in range(len(cells)):
        cell = order[alive, turn]
        alive = alive[gaps[alive, cell] <= factor * bounds[alive]]  # the stopping test
        if not len(alive):
            break
        cell = order[alive, turn]
        for at in np.unique(cell):
            who = alive[cell == at]
            scores = np.concatenate([best[who], queries[who] @ rows[cells[at]].T], axis=1)
            names = np.concatenate(
                [best_rows[who], np.broadcast_to(cells[at], (len(who), len(cells[at])))], axis=1)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best[who] = np.take_along_axis(scores, top, axis=1)
            best_rows[who] = np.take_along_axis(names, top, axis=1)
            bounds[who] = np.minimum(bounds[who], square + squares[who] - 2 * best[who, -1])
    out = []
    for i in range(len(queries)):
        found = best_rows[i][best_rows[i] >= 0]
        exact = (rows[found] * queries[i]).sum(axis=1)
        near = square + squares[i] - 2 * exact <= bounds[i] + 1e-9 * square
        out.append((found[near], exact[near]))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.ravel())
    return pa.FixedSizeListArray.from_arrays(flat, values.shape[1]).cast(pa.list_(pa.float64()))


def neighbours(rows: DataFrame, query_every: int, k: int, directions: int = DIRECTIONS,
               confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for the ids of (vec_id, v) divisible by `query_every`, the k
    other ids found with the largest inner product, ties to the smaller id.

    `vec_id` is unique and all vectors have one length (see `vectors.usable`).  Fewer than k other
    rows give all of them.  The tree is fit on about `sample` rows drawn by a hash; every row is
    indexed and every leaf that the test does not rule out is searched.
    """
    spark = rows.sparkSession
    kept = first_within(rows, ["v"], [F.col("vec_id")], k + 1, "place").drop("place")
    classes = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = settled(classes.select(F.col("ids")[0].alias("class"), "ids", "v"))
    shape = classes.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("d"),
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"),
    ).first()
    kind = dict(rows.dtypes)["vec_id"]
    if not shape["n"]:
        return spark.createDataFrame(
            [], f"query_id {kind}, rank int, vec_id {kind}, score double")
    projection = Projection(shape["d"], shape["norm"], directions)
    factor = chi_square_bound(directions, confidence)
    share = min(1.0, sample / shape["n"])
    drawn = classes.where(
        F.pmod(F.xxhash64("class", F.lit("draw")), F.lit(1 << 30)) < share * (1 << 30)
    ).select("class", "v").orderBy(F.xxhash64("class", F.lit("draw"))).limit(2 * sample)
    points = np.array([row.v for row in drawn.collect()]).reshape(-1, shape["d"])
    leaves = min(MOST_LEAVES, -(-shape["n"] // LEAF_ROWS))
    splits = Splits(projection.rows(points) if len(points) else np.zeros((1, directions)), leaves)
    # Blocks bound the rows of a task, whatever the share of a leaf.
    blocks = max(1, -(-shape["n"] // (leaves * 4 * LEAF_ROWS)))
    shared = spark.sparkContext.broadcast((projection, splits))

    def placed(batches):
        project, tree = shared.value
        for batch in batches:
            leaf = tree.leaf(project.rows(_matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf)], names=["class", "v", "leaf"])

    indexed = settled(
        classes.select("class", "v")
        .mapInArrow(placed, f"class {kind}, v array<double>, leaf bigint")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)))
    )
    # Leaves that hold more than their share are cut into more blocks.
    sizes = indexed.groupBy("leaf", "block").count()
    heavy = sizes.where(F.col("count") > 4 * LEAF_ROWS).select(
        "leaf", "block", F.ceil(F.col("count") / (4 * LEAF_ROWS)).alias("pieces"))
    indexed = settled(
        indexed.join(heavy, ["leaf", "block"], "left").withColumn(
            "block", F.col("block") + blocks * F.pmod(
                F.xxhash64("class", F.lit("piece")), F.coalesce("pieces", F.lit(1)))
        ).drop("pieces")
    )
    parts = settled(indexed.select("leaf", "block").distinct())
    asked = settled(
        rows.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "v")
        .join(classes.select("class", "v"), "v").select("query_id", "class")
    )
    queries = settled(
        indexed.join(asked.select("class").distinct(), "class", "left_semi")
        .select("class", "v", F.col("leaf").alias("home"))
    )
    square, want = projection.square, k + 1

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"class": [], "near": [], "score": []}
        if len(left) and len(right):
            project, _ = shared.value
            asking, held = _matrix(left["v"]), _matrix(right["v"])
            found = search_block(
                asking, project.queries(asking), left["bound"].to_numpy(), held,
                project.rows(held), square, factor, want,
            )
            names = right["class"].to_numpy()
            for name, (at, scores) in zip(left["class"].to_pylist(), found):
                out["class"].extend([name] * len(at))
                out["near"].extend(names[at].tolist())
                out["score"].extend(scores.tolist())
        kinds = [left.schema.field("class").type] * 2 + [pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), kinds)], names=list(out))

    def visit(asking: DataFrame) -> DataFrame:
        """Search the (class, v, leaf, bound) rows in all blocks of their leaf."""
        spread = asking.join(parts, "leaf").withColumn(
            "part", F.pmod(F.xxhash64("class"), F.lit(query_parts)))
        held = indexed.withColumn("part", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.lit(query_parts - 1).cast("bigint"))))
        keys = ["leaf", "block", "part"]
        return spread.select(*keys, "class", "v", "bound").groupBy(*keys).cogroup(
            # new aliases: both sides come from the same table
            held.select(*(F.col(name).alias(name) for name in (*keys, "class", "v"))).groupBy(*keys)
        ).applyInArrow(search, f"class {kind}, near {kind}, score double")

    query_parts = max(1, -(-queries.count() // QUERY_BLOCK))
    infinite = F.lit(float("inf"))
    order = [F.desc("score"), F.col("near")]
    first = settled(first_within(
        visit(queries.select("class", "v", F.col("home").alias("leaf"), infinite.alias("bound"))),
        ["class"], order, want, "place"))
    # The distance that is known to hold k + 1 classes, the query's own among them.
    known = first.where(F.col("place") == want).select("class", F.col("score").alias("least"))

    def onward(batches):
        """Leaves other than home whose box the stopping test does not rule out."""
        project, tree = shared.value
        for batch in batches:
            vectors = _matrix(batch.column(1))
            if not len(vectors):
                continue
            least = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            bound = square + (vectors * vectors).sum(axis=1) - 2 * least
            bound = np.where(np.isnan(least), np.inf, np.maximum(bound, 0.0) + 1e-9 * square)
            open_ = tree.distances(project.queries(vectors)) <= factor * bound[:, None]
            open_[np.arange(len(vectors)), batch.column(2).to_numpy()] = False
            at, leaf = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                 pa.array(leaf), pa.array(bound[at])], names=["class", "v", "leaf", "bound"])

    further = queries.join(known, "class", "left").select("class", "v", "home", "least").mapInArrow(
        onward, f"class {kind}, v array<double>, leaf bigint, bound double")
    found = first.drop("place").union(visit(further))
    near = first_within(found, ["class"], order, want, "place").join(
        classes.select(F.col("class").alias("near"), "ids"), "near")
    answers = asked.join(near, "class").select(
        "query_id", "score", F.explode("ids").alias("vec_id")
    ).where("vec_id <> query_id")
    return first_within(answers, ["query_id"], [F.desc("score"), F.col("vec_id")], k, "rank").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
