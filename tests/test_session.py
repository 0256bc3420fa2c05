"""Working tables and settings."""

import os
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from astrolake.operators import nodes
from astrolake.operators.ranking import first_within, numbered_within
from astrolake.session import release, tuned, work_folder


def test_queries_leave_no_tables(spark):
    folder = f"{work_folder(spark).removeprefix('file:').rstrip('/')}/astrolake"
    release()

    def tables():
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before, queries = tables(), entry_module.queries()
    for name in ("scan_dashboard", "findings_by_tier", "rule_taint", "written_report"):
        queries[name](spark, "/root/testdata/sf0.001").count()
    release()
    assert tables() <= before


def test_tuning_keeps_what_the_session_chose(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "5m")
        assert tuned(spark).conf.get(key) == "5m"
    finally:
        spark.conf.set(key, before)


def test_first_rows_above_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    rows = first_within(df, ["g"], [F.col("x")], 1500, "position")
    assert rows.groupBy("g").agg(F.max("x").alias("m"), F.count("*").alias("n")).orderBy("g") \
        .collect() == [(0, 2998, 1500), (1, 2999, 1500)]


def test_queries_leave_no_working_table(spark):
    """The node table of a query is gone once its result is there, without `release`."""
    folder = os.path.join(work_folder(spark).removeprefix("file:"), "astrolake")
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = tables()
    for name in ("scan_dashboard", "all_security_findings", "check_counts", "risk_label"):
        entry_module.queries()[name](spark, "/root/testdata/sf0.001").count()
        assert tables() == before, name


def test_readers_take_only_their_families(spark):
    from astrolake.operators import quality
    from astrolake.operators.findings import security_hits
    from astrolake.operators.scan import Scan
    from astrolake.sources.order_corpus import corpus

    with Scan.full(corpus(spark, "/root/testdata/sf0.001")) as scan:
        def folders(df):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            named = re.findall(r"family#\d+ IN \(([^)]*)\)|family#\d+ = (\w+)", plan)
            return {name for listed, one in named for name in (one or listed).split(",")}

        assert folders(quality.unused_vars(scan.nodes)) == {"store", "name"}
        assert folders(quality.dead_code(scan.nodes)) == {"flow"}
        assert folders(security_hits(scan.nodes)) == {"call", "store", "definition"}
        kinds = {r.kind: r.family for r in scan.nodes.select("kind", "family").distinct().collect()}
        assert all(kind in nodes.FAMILIES.get(family, (kind,)) for kind, family in kinds.items())


def test_positions_with_ties_nulls_and_a_hot_group(spark):
    """Positions count every row once, also rows that are equal or have nulls in their key."""
    rows = [("hot", i % 700, "x" * 50) for i in range(3000)]
    rows += [(None, 1, "n"), (None, None, "n"), (None, None, "n"), ("cold", None, None)]
    df = spark.createDataFrame(rows, "g string, x int, wide string").repartition(7)
    got = numbered_within(df, ["g"], [F.col("x")], "position")
    assert got.columns == ["g", "x", "wide", "position"]
    groups = {}
    for row in got.collect():
        groups.setdefault(row.g, []).append((row.position, row.x))
    for group, found in groups.items():
        wanted = sorted((r[1] for r in rows if r[0] == group), key=lambda x: (x is not None, x))
        assert [x for _, x in sorted(found, key=lambda r: r[0])] == wanted
        assert sorted(at for at, _ in found) == list(range(1, len(wanted) + 1))
    empty = numbered_within(df.filter("g = 'none'"), ["g"], [F.col("x")], "position")
    assert empty.count() == 0


def test_positions_keep_only_keys(spark):
    """Wide columns are neither written for the positions nor sorted over the range."""
    df = spark.createDataFrame([("a", 1, "text")], "g string, x int, wide string")
    plan = numbered_within(df, ["g"], [F.col("x")], "position")._jdf.queryExecution() \
        .optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "LogicalRDD" in line]
    assert scans and not any("wide" in line for line in scans if "_part" in line)


def test_tables_are_not_broadcast_on_estimates(spark):
    """The texts come from two small columns, so the optimizer takes any number of files, and what is
    aggregated from them, for a small table."""
    queries = entry_module.queries()
    for name in ("case_call_lines", "function_marks", "walk_membership", "calls_view",
                 "complexity_metric", "parse_failures"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        assert "BroadcastHashJoin" not in plan.toString(), name
        assert "SortMergeJoin" in plan.toString(), name
