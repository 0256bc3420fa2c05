"""Benchmark passages in training texts, found through an FM-index per shard of the texts.

The words of a shard (a slice of one task's rows) become numbers: those of the benchmark by a
dictionary, all others the separator, as no passage goes across them.  Stretches too short for any
passage are left out; the rest is indexed, all passages are searched backwards at once, and their
occurrences located by sampled positions.  Occurrences that overlap or touch become one removal span.

Passages go to the tasks in blocks of bounded bytes; a larger benchmark takes several passes over
the texts, whose spans are united row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.llm.arrow import with_computed
from astrolake.llm.fmindex import FMIndex
from astrolake.llm.words import Words
from astrolake.session import settled

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of passages sent to every task at once.
BLOCK_BYTES = 16 << 20
# Words of one index, which bounds the memory of long texts, and bytes of the rows of a slice.
SHARD_WORDS = 400_000
SHARD_BYTES = 2 << 20

SPAN = "struct<first_word:bigint,end_word:bigint,start:bigint,end:bigint>"

# In UTF-8 the same words: digits, lower-case letters and everything outside ASCII.
WORDS = Words(rb"0-9a-z\x80-\xff")


def passages(benchmark: DataFrame, id_column: str, text_column: str,
             window: int = WINDOW) -> DataFrame:
    """Distinct (item, words): every run of `window` words of an item, or the item where it has
    fewer.  Items without words give none; a null id counts as ''; rows of one id are one item."""
    text = F.translate(F.coalesce(F.col(text_column), F.lit("")), UPPER, LOWER)
    words = F.col("_words")
    runs = F.when(
        F.size(words) > window,
        F.transform(F.sequence(F.lit(1), F.size(words) - window + 1),
                    lambda at: F.slice(words, at, window)),
    ).when(F.size(words) > 0, F.array(words))
    return benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
    ).select("item", F.explode(runs).alias("words")).distinct()


class Passages:
    """Passages as numbers: rows aligned to the right, and the items of each."""

    def __init__(self, table: pa.Table):
        words = [tuple(row) for row in table.column("words").to_pylist()]
        distinct = {row: at for at, row in enumerate(dict.fromkeys(words))}
        self.vocabulary = {
            word.encode(): at + 1
            for at, word in enumerate(dict.fromkeys(w for row in distinct for w in row))
        }
        self.lengths = np.array([len(row) for row in distinct], np.int64)
        self.matrix = np.full((len(distinct), max(self.lengths, default=1)), -1, np.int64)
        for at, row in enumerate(distinct):
            numbers = [self.vocabulary[word.encode()] for word in row]
            self.matrix[at, -len(row):] = numbers
        self.names = np.array(sorted(set(table.column("item").to_pylist())), object)
        number = {name: at for at, name in enumerate(self.names)}
        pairs = np.array(
            [(distinct[row], number[item])
             for row, item in zip(words, table.column("item").to_pylist())], np.int64
        ).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.items = pairs[:, 1]
        self.item_count = np.bincount(pairs[:, 0], minlength=len(distinct))
        self.item_start = np.cumsum(self.item_count) - self.item_count


def _stretches(numbers: np.ndarray, bounds: np.ndarray, least: int, most: int,
               longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of known words within one text that can hold a passage.  Runs longer
    than `longest` are cut into overlapping ones: no passage of up to `most` words is lost."""
    change = np.zeros(len(numbers) + 1, np.int8)
    known = numbers > 0
    edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
    change[edge] = 1
    inner = bounds[(bounds > 0) & (bounds < len(numbers))]
    change[inner[known[inner] & known[inner - 1]]] = 1
    cuts = np.flatnonzero(change)
    start, end = cuts[:-1], cuts[1:]
    fits = known[start] & (end - start >= least) if len(start) else np.zeros(0, bool)
    start, end = start[fits], end[fits]
    stride = longest - most + 1
    pieces = np.maximum(1, -(-(end - start - most + 1) // stride))
    at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + at * stride
    return start, np.minimum(start + longest, np.repeat(end, pieces))


def _shards(start: np.ndarray, end: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of stretches of about `limit` words."""
    shard = np.cumsum(end - start + 1) // limit
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield slice(int(lo), int(hi))


def occurrences(numbers: np.ndarray, bounds: np.ndarray, wanted: Passages,
                shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(passage, first word) of every occurrence in the texts whose words end at `bounds`."""
    least, most = int(wanted.lengths.min()), int(wanted.lengths.max())
    start, end = _stretches(numbers, bounds, least, most, max(shard_words, 2 * most))
    passage, position = [], []
    for part in _shards(start, end, shard_words):
        size = end[part] - start[part] + 1  # with the separator
        stop = np.cumsum(size)
        origin = np.arange(stop[-1]) + np.repeat(start[part] - (stop - size), size)
        symbols = numbers[np.minimum(origin, len(numbers) - 1)].astype(np.int64)
        symbols[stop - 1] = 0
        present = np.bincount(symbols, minlength=len(wanted.vocabulary) + 1) > 0
        local = np.where(present, np.cumsum(present) - 1, 0)
        local[0] = 0
        renamed = np.where(wanted.matrix < 0, -1, local[wanted.matrix])
        candidates = np.flatnonzero((renamed != 0).all(axis=1))
        if not len(candidates):
            continue
        index = FMIndex(local[symbols], int(present.sum()))
        begin, stop = index.search(renamed[candidates])
        count = np.maximum(stop - begin, 0)
        rows = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        passage.append(np.repeat(candidates, count))
        position.append(origin[index.locate(rows)])
    if not passage:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(passage), np.concatenate(position)


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of word numbers with the code points they cover."""
    out, edge = [], {}
    wanted = {first for first, _ in spans} | {end - 1 for _, end in spans}
    for number, span in enumerate(WORDS.spans(text)):
        if number in wanted:
            edge[number] = span
    codes = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=codes[1:])
    for first, end in spans:
        begin, stop = edge[first][0], edge[end - 1][1]
        out.append({"first_word": first, "end_word": end,
                    "start": int(codes[begin]), "end": int(codes[stop])})
    return out


def _find(texts: list[bytes], wanted: Passages) -> tuple[list[int], list[list], list[list]]:
    """Number of words, merged spans and items of each text."""
    get = wanted.vocabulary.get
    parts = [WORDS.numbers(text, get, repeat(0)) for text in texts]
    sizes = np.array([len(part) for part in parts], np.int64)
    bounds = np.cumsum(sizes)
    numbers = np.concatenate(parts)
    spans: list[list] = [[] for _ in texts]
    items: list[list] = [[] for _ in texts]
    passage, first = occurrences(numbers, bounds, wanted)
    if not len(passage):
        return sizes.tolist(), spans, items
    length = wanted.lengths[passage]
    cover = np.bincount(first, minlength=len(numbers) + 1).astype(np.int64)
    cover -= np.bincount(first + length, minlength=len(numbers) + 1)
    hit = np.cumsum(cover)[:-1] > 0
    edges = np.diff(hit, prepend=False, append=False)
    starts = np.append(hit, False)
    inner = bounds[:-1][bounds[:-1] < len(numbers)]
    edges[inner[hit[inner] & hit[np.maximum(inner, 1) - 1]]] = True  # a span ends with its text
    cuts = np.flatnonzero(edges)
    begin, end = cuts[:-1], cuts[1:]
    inside = starts[begin]
    begin, end = begin[inside], end[inside]
    owner = np.searchsorted(bounds, begin, side="right")
    base = bounds - sizes
    by_text: dict[int, list[tuple[int, int]]] = {}
    for text, lo, hi in zip(owner.tolist(), begin.tolist(), end.tolist()):
        by_text.setdefault(text, []).append((lo - int(base[text]), hi - int(base[text])))
    for text, found in by_text.items():
        spans[text] = _offsets(texts[text], found)
    pair = np.unique(np.searchsorted(bounds, first, side="right") * len(wanted.lengths) + passage)
    at, passage = np.divmod(pair, len(wanted.lengths))
    for text in np.unique(at):
        mine = passage[at == text]
        rows = np.concatenate([
            wanted.items[lo:lo + n]
            for lo, n in zip(wanted.item_start[mine], wanted.item_count[mine])])
        items[text] = wanted.names[np.unique(rows)].tolist()
    return sizes.tolist(), spans, items


def _searched(df: DataFrame, text_column: str, wanted: Passages, tag: str) -> DataFrame:
    span = pa.struct([(name, pa.int64()) for name in ("first_word", "end_word", "start", "end")])

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            # equal texts of a slice are searched once
            coded = texts.cast(pa.binary()).fill_null(b"").dictionary_encode()
            words, spans, items = _find(coded.dictionary.to_pylist(), wanted)
            return [column.take(coded.indices) for column in (
                pa.array(words, pa.int64()), pa.array(spans, pa.list_(span)),
                pa.array(items, pa.list_(pa.string())))]

        return run

    return with_computed(
        df, text_column,
        f"_words{tag} bigint, _spans{tag} array<{SPAN}>, _items{tag} array<string>",
        make, SHARD_BYTES)


def _united(spans: Column) -> Column:
    """Spans of several passes as one list: those that overlap or touch, in words, are one."""
    empty = F.array().cast(f"array<{SPAN}>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first_word"].alias("first_word"),
            F.greatest(last["end_word"], span["end_word"]).alias("end_word"),
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end_word"] >= span["first_word"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contaminated_spans(df: DataFrame, text_column: str, benchmark: DataFrame, item_column: str,
                       item_text: str, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`df` with `n_words`, `n_hit`, `spans` and `items` (existing columns of these names are
    replaced): how many words a text has and how many stand in an occurrence of a passage of
    `benchmark`; the merged spans, in words and in code points, ends exclusive; the sorted ids of the
    items with an occurrence.

    Words are runs of digits, letters and characters outside ASCII, A-Z lower-cased.  A null or empty
    text has none.  An empty benchmark finds nothing.  Rows with equal ids or texts are judged alike,
    each for itself.  A text of any length is searched whole.
    """
    table = passages(benchmark, item_column, item_text, window)
    weight = F.octet_length(F.array_join("words", " ")) + F.octet_length("item")
    total = table.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        table = settled(table.withColumn(
            "_block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))))
    outputs = ("n_words", "n_hit", "spans", "items")
    kept = [name for name in df.columns if name not in outputs]
    found = df.select(F.col(text_column).alias("_text"), *(F.col(name).alias(f"c_{name}") for name in kept))
    tags = []
    for block in range(blocks):
        part = table.where(F.col("_block") == block) if blocks > 1 else table
        wanted = Passages(part.select("item", "words").toArrow())
        if len(wanted.lengths):
            tags.append(str(block))
            found = _searched(found, "_text", wanted, tags[-1])
    if not tags:
        # no passage: only the words are counted
        lowered = F.translate(F.coalesce("_text", F.lit("")), UPPER, LOWER)
        return found.select(
            *(F.col(f"c_{name}").alias(name) for name in kept),
            F.regexp_count(lowered, F.lit(WORD)).cast("bigint").alias("n_words"),
            F.lit(0).cast("bigint").alias("n_hit"),
            F.array().cast(f"array<{SPAN}>").alias("spans"),
            F.array().cast("array<string>").alias("items"),
        )
    spans, items = F.col(f"_spans{tags[0]}"), F.col(f"_items{tags[0]}")
    if len(tags) > 1:
        spans = _united(F.concat(*(f"_spans{tag}" for tag in tags)))
        items = F.array_sort(F.array_distinct(F.concat(*(f"_items{tag}" for tag in tags))))
    found = found.select(
        *(F.col(f"c_{name}").alias(name) for name in kept),
        F.col(f"_words{tags[0]}").alias("n_words"), spans.alias("spans"), items.alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"),
                        lambda n, span: n + span["end_word"] - span["first_word"])
    return found.withColumn("n_hit", n_hit)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the given spans of code points (sorted, disjoint)."""
    cuts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]),
                    F.array(F.length(text).cast("bigint")))
    return F.array_join(F.transform(F.arrays_zip(cuts.alias("a"), ends.alias("b")), lambda p: F.substring(
        text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))), "")
