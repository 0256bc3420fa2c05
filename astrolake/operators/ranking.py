"""Positions within groups, without sending a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolake.session import settled, spread


def numbered_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based position of each row in its group, in the given order.

    A window partitioned by the group alone would sort a hot group in one task.  Here only the keys
    (group and order, with the number of rows that share them) are range-partitioned, kept, and
    summed inside (partition, group); the keys of a group in earlier partitions shift them.  Those
    offsets have one row per partition and group.  The rows themselves, with their wide columns, move
    once: they are hashed by the whole key to meet their position, so a hot group is spread.  `df` is
    read twice, with its key columns and with all.  Rows that share a key may be numbered either way.
    """
    orders = [f"_o{at}" for at in range(len(order))]
    groups = [f"_g{at}" for at in range(len(by))]
    parts = (*groups, *orders)
    # Structs meet where their fields are equal or both null.  Joined by one column, the rows of a key
    # are already together and sorted for the window over ties.
    keyed = df.withColumn("_key", F.struct(
        *(F.col(b).alias(g) for b, g in zip(by, groups)),
        *(column.alias(o) for o, column in zip(orders, order))))
    slim = keyed.groupBy("_key").agg(F.count("*").alias("_n")).select(
        *(F.col("_key")[p].alias(p) for p in parts), "_n")
    ranged = slim.repartitionByRange(*groups, *orders).withColumn("_part", F.spark_partition_id())
    # Range bounds are sampled anew on each run: keep the keys so that both uses see the same.
    fixed = settled(ranged)
    before = Window.unboundedPreceding, -1
    offsets = (
        fixed.groupBy(*groups, "_part").agg(F.sum("_n").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(
            Window.partitionBy(*groups).orderBy("_part").rowsBetween(*before)), F.lit(0)))
    )
    inside = Window.partitionBy("_part", *groups).orderBy(*orders).rowsBetween(*before)
    ahead = fixed.withColumn("_ahead", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    same_group = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*groups, "_part")]
    starts = ahead.alias("a").join(offsets.alias("b"), same_group).select(
        F.struct(*(F.col(f"a.{p}").alias(p) for p in parts)).alias("_key"),
        (F.col("_ahead") + F.col("_offset")).alias("_start"),
    )
    met = keyed.join(spread(starts), "_key")
    ties = Window.partitionBy("_key").orderBy(F.lit(0))
    return met.withColumn(name, F.col("_start") + F.row_number().over(ties)).select(
        *df.columns, name)


def first_within(df: DataFrame, by: list[str], order: list[Column], limit: int,
                 name: str) -> DataFrame:
    """The first `limit` rows of each group.  Filtering on row_number lets the planner keep only
    `limit` rows per group in each task before the shuffle (WindowGroupLimit).  It does so up to a
    threshold; beyond it a group is numbered across tasks."""
    threshold = int(df.sparkSession.conf.get(
        "spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if limit > threshold:
        return numbered_within(df, by, order, name).filter(F.col(name) <= limit)
    return df.withColumn(
        name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ).filter(F.col(name) <= limit)
