"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits.  It is cut into segments.  Two fingerprints that differ in at most
`max_bits` bits agree, in at least one segment, up to a small number of bits: each fingerprint
enumerates the small Hamming ball around its value in every segment, the probes meet the table of
segment values in an equi-join, and the join condition verifies the complete distance.

Equal fingerprints are folded before, so that copies cost one row.  Groups are connected components
of the links, found by alternating star contractions on the links alone.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.llm.arrow import with_computed
from astrolake.session import settled

SEED = 42


def fingerprint_values(texts: list[bytes | None], words: int) -> np.ndarray:
    """64-bit fingerprints of texts: majority bits of the hashes of all word shingles."""
    counts = np.zeros(len(texts), np.int64)
    hashes: list[np.ndarray] = []
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        # bytes.lower maps A-Z only, bytes.split cuts at \x20 and \x09-\x0D
        tokens = text.lower().split() if text else []
        if not tokens:
            continue
        joined = b" ".join(tokens)
        if len(tokens) < words:
            counts[i] = 1
            hashes.append(np.array([digest(joined, SEED)], np.uint64))
            continue
        stops = list(accumulate(map(len, tokens), lambda end, size: end + 1 + size))
        starts = [0, *(stop + 1 for stop in stops[:len(stops) - words])]
        counts[i] = n = len(starts)
        shingles = map(joined.__getitem__, map(slice, starts, stops[words - 1:]))
        hashes.append(np.fromiter(map(digest, shingles, repeat(SEED)), np.uint64, n))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    values = np.concatenate(hashes)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    begin = np.cumsum(counts[full]) - counts[full]
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    majority = (2 * ones > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, column: str, words: int = 3,
                 output: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of a text column as a `bigint` of its 64 bits.

    A-Z are lower-cased, words are runs without \\x20 and \\x09-\\x0D, shingles are `words` words
    joined by one space, repeats included.  A text with fewer words is one shingle; a null text or
    one without words has fingerprint zero.  A column named `output` is replaced.
    """
    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            values = fingerprint_values(texts.cast(pa.binary()).to_pylist(), words)
            return [pa.array(values.view(np.int64))]

        return run

    return with_computed(df, column, f"`{output}` bigint", make)


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    bounds = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(bounds, bounds[1:])]


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` of `width` bits."""
    return [
        sum(1 << bit for bit in bits)
        for size in range(radius + 1) for bits in combinations(range(width), size)
    ]


def _segment_value(fingerprint: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column `fingerprint` that differ in at
    most `max_bits` bits.  A pair may come once per segment that finds it.

    With q, r = divmod(max_bits, segments), the first r + 1 segments are probed to radius q and the
    others to q - 1: if every one of them differed by more, the sum would exceed `max_bits`.
    """
    q, r = divmod(max_bits, segments)
    value = F.col("fingerprint")
    table, probes = [], []
    for at, (first, width) in enumerate(_segments(segments)):
        radius = q if at <= r else q - 1
        if radius < 0:
            continue
        part = _segment_value(value, first, width)
        table.append(F.struct(F.lit(at).alias("at"), part.alias("key")))
        probes.append(F.array(*(
            F.struct(F.lit(at).alias("at"), part.bitwiseXOR(F.lit(mask)).alias("key"))
            for mask in _ball(width, radius)
        )))
    left = distinct.select(
        value.alias("a"), F.explode(F.concat(*probes)).alias("probe")
    ).select("a", "probe.at", "probe.key")
    right = distinct.select(
        value.alias("b"), F.explode(F.array(*table)).alias("probe")
    ).select("b", "probe.at", "probe.key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, ["at", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reachable.

    Alternates large-star and small-star until nothing changes: about log(n) rounds, each a few
    shuffles of the links.  Only two numbers per round reach the driver.
    """
    edges = settled(pairs.where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(
            F.least("a", "m").alias("a"), F.col("b")
        ).where("a <> b").distinct()
        # small star: every node's smaller neighbours, and the node, point at the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(
            F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")
        )
        edges = settled(small.where("x <> y").select(
            F.col("x").alias("a"), F.col("y").alias("b")
        ).distinct())
    roots = edges.groupBy("b").agg(F.min("a").alias("root"))
    return roots.select(F.col("b").alias("node"), "root").union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def groups(prints: DataFrame, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """(fingerprint, root) of every distinct fingerprint of `prints`; linked ones share the root."""
    distinct = settled(prints.select("fingerprint").distinct())
    member = components(links(distinct, max_bits, segments))
    return distinct.join(
        member.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(df: DataFrame, id_column: str, text_column: str, words: int = 3,
                    max_bits: int = 2, segments: int = 2) -> DataFrame:
    """(id_column, fingerprint, component_id) of every row: `component_id` is the smallest id among
    the rows reachable over links of at most `max_bits` differing bits.

    Rows without id belong to their component like others; a component without any id has a null
    `component_id`.  Repeated rows give repeated rows.
    """
    prints = settled(fingerprints(
        df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")), "_text", words
    ).select("_id", "fingerprint"))
    first = prints.groupBy("fingerprint").agg(F.min("_id").alias("first_id"))
    grouped = settled(groups(prints, max_bits, segments).join(first, "fingerprint"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = grouped.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(label, "fingerprint").select(
        F.col("_id").alias(id_column), "fingerprint", "component_id"
    )


def one_per_group(df: DataFrame, id_column: str, text_column: str, words: int = 3,
                  max_bits: int = 2, segments: int = 2) -> DataFrame:
    """The rows of `df` without near-duplicates: of each component the row with the smallest id
    stays.  Rows without id come last; equal ids are ordered by a hash of the row; of rows equal in
    all columns one stays.  The columns are those of `df`.

    Only (id, fingerprint, row hash) take part in the grouping; the texts move once, in the join
    that picks the rows.
    """
    comparable = [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    marked = df.withColumn("_row", F.xxhash64(*comparable))
    slim = settled(fingerprints(
        marked.select(F.col(id_column).alias("_id"), "_row", F.col(text_column).alias("_text")),
        "_text", words
    ).groupBy("_id", "_row", "fingerprint").agg(F.count("*").alias("_copies")))
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_row", "_copies")
    # Rows of one fingerprint fold before they meet its group, so copies are one row there.
    first = slim.groupBy("fingerprint").agg(F.min(order).alias("best"))
    chosen = settled(
        first.join(groups(slim, max_bits, segments), "fingerprint")
        .groupBy("root").agg(F.min("best").alias("best")).select("best.*")
    )
    kept = marked.join(
        chosen.select("_id", F.col("_row").alias("_chosen")),
        F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_chosen")),
        "left_semi",
    )
    if not chosen.where("_copies > 1").isEmpty():
        kept = kept.dropDuplicates(comparable)
    return kept.select(*df.columns)
