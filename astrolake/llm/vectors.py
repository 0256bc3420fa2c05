"""Vectors fit for a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fit(df: DataFrame, id_column: str, vector_column: str, zero: bool) -> DataFrame:
    """(vec_id, v) of the rows with an id and a finite vector; without `zero`, not a zero vector."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    return rows if zero else rows.where(F.exists(v, lambda x: x != 0))


def usable(df: DataFrame, id_column: str, vector_column: str, zero: bool = True) -> DataFrame:
    """(vec_id, v): one row per id with its vector as `array<double>`.

    Rows without id or vector, and vectors that are empty or hold null or non-finite components, take
    no part; without `zero`, zero vectors neither.  Of rows with equal ids the least vector counts.
    Vectors of another length than the most frequent one (ties: the longest) take no part.
    """
    v = F.col("v")
    rows = _fit(df, id_column, vector_column, zero)
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size(v) == (common["n"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def uniform(df: DataFrame, id_column: str, vector_column: str, zero: bool = True,
            mixed: bool = False) -> DataFrame:
    """The rows of `usable`, of a table in which only rows without id or fit vector are left out.

    Vectors of several lengths are an error at once, unless `mixed` lets them in; other vectors under
    one id are an error when the rows are read.  Rows equal in id and vector are one.
    """
    rows = _fit(df, id_column, vector_column, zero)
    lengths = rows.select(F.size("v").alias("n")).distinct().limit(2)
    sizes = [] if mixed else [row.n for row in lengths.collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths, such as {min(sizes)} and {max(sizes)}")
    ends = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("v").alias("most"))
    return ends.select("vec_id", F.when(F.col("v") == F.col("most"), F.col("v")).otherwise(
        F.raise_error(F.concat(F.lit("several vectors of id "), F.col("vec_id").cast("string")))
    ).alias("v"))
