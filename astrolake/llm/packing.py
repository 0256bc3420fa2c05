"""Packing of documents into token sequences along a space-filling curve.

Documents are tokenised once.  The hashed token counts of a document are projected to a few
dimensions; the projections are standardised with corpus statistics and quantised; the Hilbert key
of the cell orders the documents, so that neighbours on the curve have similar vocabulary.  The
stream of all documents in that order is cut every `length` tokens.

Only (row, key, count) rows are range-sorted.  Prefix sums need one number per range partition.
The tokens move once, in the join with the positions.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolake.llm.arrow import with_computed
from astrolake.llm.bpe import WordTable
from astrolake.session import settled, write_table

LENGTH = 1024
END = 0
DIMENSIONS = 3
BITS = 10
BUCKETS = 1024
WORDS_AT_ONCE = 2000  # new words the model gets in one call


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of the cells (rows, dimensions) of a grid of 2**bits per side.

    Two neighbours on the curve are neighbouring cells.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # From the top bit down, undo the reflections and exchanges of the enclosing cubes.
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(n):
            set_ = (x[axis] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[axis] ^= swap if axis else 0
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = key << 1 | (x[axis] >> level & 1)
    return key


def projection(dimensions: int) -> np.ndarray:
    """Fixed random directions of the hash buckets (buckets, dimensions)."""
    return np.random.default_rng(11).standard_normal((BUCKETS, dimensions))


def byte_alphabet() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable ones as they are, the others
    in order from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + at) for at, b in enumerate(others)}


_TABLES: dict[str, WordTable] = {}


def _words(path: str, pattern: str) -> WordTable:
    if path not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
        characters = np.array([ord(alphabet[b]) for b in range(256)], "<u4")
        special = {}
        for number, token in tokenizer.get_added_tokens_decoder().items():
            if token.single_word or token.lstrip or token.rstrip or token.normalized:
                raise ValueError(f"added token with a rule of its own: {token.content}")
            special[token.content.encode()] = number
        # The model alone, for words in its alphabet, which has no space.
        model = Tokenizer(tokenizer.model)
        model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = model.get_vocab()
        size = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)  # bytes of each token
        for token, number in vocabulary.items():
            size[number] = len(token)

        def written(words: list[bytes]) -> list[str]:
            """The words in the model's alphabet, a character per byte."""
            raw = np.frombuffer(b"".join(words), np.uint8)
            text, ends = characters[raw].tobytes().decode("utf-32-le"), accumulate(map(len, words))
            return [text[end - len(word):end] for word, end in zip(words, ends)]

        def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for lo in range(0, len(words), WORDS_AT_ONCE):
                part = words[lo:lo + WORDS_AT_ONCE]
                added = [at for at, word in enumerate(part) if word in special]
                text = written(part)
                for at in added:
                    text[at] = text[at][:1]  # holds the place
                found, = model.encode_batch_fast([" ".join(text)], add_special_tokens=False)
                ids.append(np.array(found.ids, np.int32))
                # The tokens of a word have as many bytes as the word.
                ends = np.searchsorted(
                    np.cumsum(size[ids[-1]]), np.cumsum([len(word) for word in text]), "left") + 1
                lengths.append(np.diff(ends, prepend=0))
                for at in added:
                    ids[-1][ends[at] - 1] = special[part[at]]
            return np.concatenate(ids), np.concatenate(lengths)

        table = WordTable(pattern, encode_words)
        if special:
            # The library takes strings of added tokens out of a text before it splits the rest; the
            # pattern alone never gives such a string as one word.
            names = sorted((name.decode() for name in special), key=len, reverse=True)
            parted = re.compile("(" + "|".join(map(re.escape, names)) + ")")
            plain = table.findall
            table.findall = lambda text: plain(text) if not any(
                name in text for name in names
            ) else [word for at, part in enumerate(parted.split(text))
                    for word in ([part] if at % 2 else plain(part))]
        _TABLES[path] = table
    return _TABLES[path]


def tokenised(df: DataFrame, column: str, path: str, pattern: str, end: int = END,
              dimensions: int = DIMENSIONS) -> DataFrame:
    """`df` with `_ids` (little-endian ids, 2 bytes each, 4 if an id needs them, `_wide`), `_n` and
    the projection `_p` of the hashed document vector.

    The tokenizer must be byte-level, with `pattern` as its split.  Its model works on one match at
    a time, so a word is encoded once per worker, with many others in one call.  Strings of added tokens in a text get the ids of
    those tokens, as the library gives them unless told otherwise.  A null text counts as empty.
    """
    def make():
        table = _words(path, pattern)
        directions = projection(dimensions)

        def run(texts: pa.Array) -> list[pa.Array]:
            values, counts = table.encode([t or "" for t in texts.to_pylist()])
            bucket = (values.astype(np.int64) * 2654435761 >> 7) % BUCKETS
            full = np.flatnonzero(counts)
            means = np.zeros((len(counts), dimensions))
            if len(full):
                begin = np.cumsum(counts[full]) - counts[full]
                for axis in range(dimensions):
                    sums = np.add.reduceat(directions[bucket, axis], begin)
                    means[full, axis] = sums / counts[full]
            stop = np.cumsum(counts)
            ids = np.insert(values, stop, end)  # `end` behind every document
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            ids = ids.astype("<u4" if wide else "<u2")
            bounds = np.concatenate([[0], stop + np.arange(1, len(stop) + 1)]) * ids.itemsize
            packed = pa.Array.from_buffers(
                pa.large_binary(), len(stop),
                [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])
            return [
                packed, pa.array(np.full(len(stop), wide)), pa.array(counts + 1),
                pa.FixedSizeListArray.from_arrays(pa.array(means.ravel()), dimensions)
                .cast(pa.list_(pa.float64())),
            ]

        return run

    return with_computed(df, column, "_ids binary, _wide boolean, _n bigint, _p array<double>", make)


def positions(documents: DataFrame, id_column: str, dimensions: int = DIMENSIONS,
              bits: int = BITS) -> DataFrame:
    """(_row, _start): first position of each document in the stream along the curve.

    The order is total: Hilbert key, id, row.  So documents of one cell, copies above all, are
    spread over as many range partitions as they need.
    """
    p = [F.col("_p")[axis] for axis in range(dimensions)]
    moments = documents.agg(*(
        f(x).alias(f"{name}{axis}") for axis, x in enumerate(p)
        for name, f in (("m", F.avg), ("s", F.stddev_pop))
    )).first()
    side = 1 << bits
    cells = []
    for axis, x in enumerate(p):
        mean, deviation = moments[f"m{axis}"] or 0.0, moments[f"s{axis}"] or 1.0
        share = 1 / (1 + F.exp((mean - x) * (1.702 / deviation)))
        cells.append(F.least(F.floor(share * side), F.lit(side - 1)).cast("bigint"))
    slim = documents.select("_row", F.col(id_column).alias("_id"), "_n", F.array(*cells).alias("_c"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            key = hilbert_key(flat.reshape(batch.num_rows, dimensions), bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(key)], names=["_row", "_id", "_n", "_key"]
            )

    kind = dict(slim.dtypes)["_id"]
    order = ["_key", "_id", "_row"]
    ranged = settled(
        slim.mapInArrow(keyed, f"_row bigint, _id {kind}, _n bigint, _key bigint")
        .repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(
        "_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ).join(base, "_part").select("_row", (F.col("_base") + F.col("_inside")).alias("_start"))


def pack(df: DataFrame, id_column: str, text_column: str, tokenizer_path: str,
         pattern: str = public_tokenizers.PATTERN, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of a document: (id_column, start, length, doc_tokens, sequence_id, offset,
    ids), ids as little-endian unsigned 32-bit numbers.

    Every document is its ids followed by `end`; a null or empty text is `end` alone.  Pieces of one
    sequence follow each other without gaps; all sequences but the last are full, so only the last
    needs padding.  Rows without id, and rows with equal ids, are documents of their own.
    """
    named = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    path = write_table(
        tokenised(named, "_text", tokenizer_path, pattern, end).drop("_text")
        .withColumn("_row", F.monotonically_increasing_id()), "packing",
    )
    documents = df.sparkSession.read.parquet(path)
    placed = documents.select("_row", "_id", "_ids", "_wide", "_n").join(
        positions(documents.select("_row", "_id", "_n", "_p"), "_id"), "_row"
    ).select("_id", "_ids", "_wide", "_n", "_start")
    kind = dict(named.dtypes)["_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows, ids = [], [], []
            for at, (packed, wide, n, begin) in enumerate(zip(*(
                batch.column(i).to_pylist() for i in range(1, 5)
            ))):
                values = packed if wide else np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                first = 0
                while first < n:
                    offset = (begin + first) % length
                    size = min(length - offset, n - first)
                    source.append(at)
                    rows.append((first, size, n, (begin + first) // length, offset))
                    ids.append(values[4 * first:4 * (first + size)])
                    first += size
            numbers = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), *map(pa.array, numbers),
                 pa.array(ids, pa.binary())],
                names=["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(
        cut, f"_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
             "offset bigint, ids binary"
    ).withColumnRenamed("_id", id_column)
