"""Divergence between the sources of a language, term by term, in exact whole numbers.

Counts of terms are aggregated per (lang, source, term).  The sources of a language are dealt into
blocks, and so are its kept terms.  A slice is what the sources of one block say about the terms of
one block; it is replicated to every cell (source block, source block, term block) that needs it.
Each cell adds up the divergences of its pairs of sources over its terms, and the sums of the cells
are reduced along the terms.  The size of a slice, and so of a cell, is bounded by the two block
sizes, whatever the size of a language, source or vocabulary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolake.llm.arrow import bound_batches, slices
from astrolake.llm.words import Words
from astrolake.session import settled

UNIT = 1_000_000_000
MIN_DOCS = 10
# Sources and terms of a slice.
SOURCE_BLOCK = 64
TERM_BLOCK = 4096
TOP_TERMS = 10
# Rows of a table about languages or sources that is sent to all tasks.
BROADCAST_ROWS = 50_000

# Letters and everything outside ASCII.
WORDS = Words(rb"a-z\x80-\xff")
# Bytes of text whose terms are counted together before they leave the task.
COUNT_BYTES = 8 << 20


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), digit by digit in base 1000, so that
    nothing overflows below 9 * 10**15 counts."""
    size = total + 2 * kept
    quotient, rest = F.lit(0).cast("bigint"), count + 2
    for _ in range(3):
        digit = _div(rest * 1000, size)
        quotient, rest = quotient * 1000 + digit, rest * 1000 % size
    return quotient + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of the terms of a batch of (lang, source, text)."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    texts = batch.column(2).cast(pa.binary()).to_pylist()
    parts = [WORDS.numbers(text, number.__getitem__) if text else _NO_WORDS for text in texts]
    groups = pa.StructArray.from_arrays(
        [batch.column(0), batch.column(1)], ["lang", "source"]).to_pylist()
    known = {group: at for at, group in enumerate(dict.fromkeys((g["lang"], g["source"]) for g in groups))}
    group_of = np.array([known[g["lang"], g["source"]] for g in groups], np.int64)
    size = max(1, len(number))
    in_text = np.concatenate([at * size + part.astype(np.int64) for at, part in enumerate(parts)])
    pairs, times = np.unique(in_text, return_counts=True)
    text, term = np.divmod(pairs, size)
    rows, place = np.unique(group_of[text] * size + term, return_inverse=True)
    group, term = np.divmod(rows, size)
    names = list(known)
    return pa.RecordBatch.from_arrays([
        pa.array([name[0] for name in names], pa.string()).take(pa.array(group)),
        pa.array([name[1] for name in names], pa.string()).take(pa.array(group)),
        pa.array(list(number), pa.binary()).cast(pa.string()).take(pa.array(term)),
        pa.array(np.bincount(place, times, len(rows)).astype(np.int64)),
        pa.array(np.bincount(place, minlength=len(rows)).astype(np.int64)),
    ], names=["lang", "source", "term", "n", "docs"])


_NO_WORDS = np.empty(0, np.int32)


def _named(df: DataFrame, lang: str, source: str, *others: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"),
                     F.coalesce(F.col(source), F.lit("")).alias("source"), *others)


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, COUNT_BYTES):
                yield _counted(part)

    return _named(df, lang, source, F.col(text).alias("text")).mapInArrow(
        run, "lang string, source string, term string, n bigint, docs bigint"
    ).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of terms in at least `min_docs` documents of the language, with the language's
    count `lang_n`; `lead` marks one row of each (lang, term)."""
    term = Window.partitionBy("lang", "term")
    return counts.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"),
        F.sum("docs").over(term).alias("_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("lead"),
    ).where(F.col("_docs") >= min_docs).drop("_docs")


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, settled; marked for broadcast if it has at most `limit` rows, else joined by shuffle."""
    rows = settled(df)
    return F.broadcast(rows) if rows.count() <= limit else rows


def _blocks(size: Column, limit: int) -> Column:
    return F.greatest(F.ceil(size / limit), F.lit(1)).cast("int")


def _dealt(name: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")


class Audit:
    """Counts of a table, settled once, and the two reports on them.

    A null text, language or source counts as ''.  Every row is a document.  A group without kept
    terms has a row like any other; a language without kept terms has divergences of 0.
    """

    def __init__(self, df: DataFrame, text: str, lang: str, source: str, min_docs: int = MIN_DOCS,
                 source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK):
        counted = settled(kept_counts(term_counts(df, text, lang, source), min_docs))
        terms = counted.where("lead").select("lang", "term", "lang_n")
        sizes = _small(terms.groupBy("lang").agg(
            F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")))
        occurring = _named(df, lang, source).groupBy("lang", "source").agg(F.count("*").alias("_rows"))
        sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = settled(occurring.join(sums, ["lang", "source"], "left").join(
            sizes, "lang", "left"
        ).select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("kept", F.lit(0)).alias("kept"), "lang_total"))
        per_lang = _small(groups.groupBy("lang").agg(F.count("*").alias("_sources")).select(
            "lang", _blocks(F.col("_sources"), source_block).alias("source_blocks")))
        term_blocks = _blocks(F.col("kept"), term_block).alias("term_blocks")
        self.groups = _small(groups.join(per_lang, "lang").select(
            "*", term_blocks, _dealt("source", "source_blocks").alias("source_block")))
        self.counted = counted.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "lang_n", "lang_total", "kept", "source_block",
            _dealt("term", "term_blocks").alias("term_block"),
            share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
        self.terms = terms.join(sizes.select("lang", term_blocks), "lang").select(
            "lang", "term", _dealt("term", "term_blocks").alias("term_block"))

    def top_terms(self, top: int = TOP_TERMS) -> DataFrame:
        """(lang, source, item, value, rank): the terms a group uses more than its language does."""
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        found = self.counted.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q"))
        found = found.where(F.col("p") > F.col("q")).select(
            "lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
        return _ranked(found).where(F.col("rank") <= top)

    def slices(self) -> DataFrame:
        """One row per (lang, source block, term block): all sources of the block with their share of
        an absent term, the number of terms of the block, and the shares of present terms as
        (source number, term number, share)."""
        absent = share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept"))
        members = self.groups.groupBy("lang", "source_block", "source_blocks", "term_blocks").agg(
            F.array_sort(F.collect_list(F.struct(
                "source", F.when(F.col("kept") > 0, absent).otherwise(1).alias("p0")))).alias("members"))
        grid = members.select(
            "*", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
        inside = Window.partitionBy("lang", "term_block").orderBy("term")
        numbered = self.terms.withColumn("number", F.row_number().over(inside) - 1)
        width = numbered.groupBy("lang", "term_block").agg(F.count("*").cast("int").alias("n_terms"))
        present = self.counted.join(numbered, ["lang", "term", "term_block"]).groupBy(
            "lang", "source_block", "term_block"
        ).agg(F.collect_list(F.struct("source", "number", "p")).alias("present"))
        keys = ["lang", "source_block", "term_block"]
        return grid.join(present, keys, "left").join(width, ["lang", "term_block"], "left").select(
            *keys, "source_blocks", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
            "members.source", "members.p0", F.col("present.source").alias("at_source"),
            F.col("present.number").alias("at_term"), F.col("present.p").alias("p"))

    def cells(self) -> DataFrame:
        """(lang, a, b, part): divergence of two sources a < b over the terms of one cell."""
        other = F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)).alias("other")
        replicated = self.slices().select("*", other).select(
            "lang", "term_block", "source_block",
            F.least("source_block", "other").alias("low"), F.greatest("source_block", "other").alias("high"),
            "n_terms", "source", "p0", "at_source", "at_term", "p")
        return replicated.groupBy("lang", "low", "high", "term_block").applyInArrow(
            _cell, "lang string, a string, b string, part bigint")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): every other source of the language, with the divergence
        over all kept terms."""
        sums = self.cells().groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
        both = sums.select("lang", "value", F.explode(F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("pair"))
        return _ranked(both.select("lang", "pair.source", "pair.item", "value"))


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def _shares(row: dict, number: dict[int, int]) -> np.ndarray:
    """Shares (source, term) of a slice, over the terms in `number`."""
    base = np.array(row["p0"], np.int64)
    table = np.repeat(base[:, None], len(number), axis=1)
    if row["p"]:
        source = {name: at for at, name in enumerate(row["source"])}
        table[[source[name] for name in row["at_source"]],
              [number[term] for term in row["at_term"]]] = row["p"]
    return table


def _cell(cell: pa.Table) -> pa.Table:
    """Partial divergences of one cell: its one or two slices, each with at most a block of sources
    and of terms.  Terms that no source of the cell has are added as one.  Where one of two blocks
    has no sources there are no pairs."""
    rows = sorted(cell.to_pylist(), key=lambda row: row["source_block"])
    low, high = rows[0], rows[-1]
    within = low["low"] == low["high"]
    met = sorted({term for row in rows for term in row["at_term"] or ()})
    number = {term: at for at, term in enumerate(met)}
    left, right = _shares(low, number), _shares(high, number)
    left0, right0 = np.array(low["p0"], np.int64), np.array(high["p0"], np.int64)
    rest = low["n_terms"] - len(met)
    a, b, part = [], [], []
    for at, name in enumerate(low["source"] if within or len(rows) == 2 else ()):
        first = at + 1 if within else 0  # within one block, each pair once
        others = high["source"][first:]
        if not others:
            continue
        p, q = left[at], right[first:]
        values = ((p - q) ** 2 // (p + q)).sum(axis=1)
        p, q = left0[at], right0[first:]
        values += rest * ((p - q) ** 2 // (p + q))
        for other, value in zip(others, values.tolist()):
            a.append(min(name, other))
            b.append(max(name, other))
            part.append(value)
    return pa.table({
        "lang": pa.array([low["lang"]] * len(a), pa.string()), "a": pa.array(a, pa.string()),
        "b": pa.array(b, pa.string()), "part": pa.array(part, pa.int64())})


def audit(df: DataFrame, text: str, lang: str, source: str, min_docs: int = MIN_DOCS,
          source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK,
          top: int = TOP_TERMS) -> DataFrame:
    """Both reports as (lang, source, part, item, value, rank): `pair` ranks the other sources of the
    language by divergence, `term` the terms that set a source apart from its language."""
    job = Audit(df, text, lang, source, min_docs, source_block, term_block)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return job.pairs().withColumn("part", F.lit("pair")).select(*columns).unionByName(
        job.top_terms(top).withColumn("part", F.lit("term")).select(*columns))
