"""Severity model, scores, rankings and evaluation."""

import pytest
from pyspark.sql import functions as F

from astrolake.functions import severity as S
from astrolake.functions.text import html_escaped, preview
from astrolake.operators import evaluate, report, scoring
from astrolake.operators.nodes import Needs
from astrolake.operators.ranking import first_within, numbered_within

FINDING = "repo_id string, severity string, confidence string"


def findings(spark, rows):
    return spark.createDataFrame(rows, FINDING)


def test_effective_severity(spark):
    rows = [("r", s, c) for s in ("critical", "high", "medium", "low")
            for c in ("high", "medium", "low")]
    rated = scoring.with_effective_severity(findings(spark, rows)).collect()
    low = {"critical": "high", "high": "medium", "medium": "low", "low": "low"}
    for r in rated:
        assert r.effective_severity == (low[r.severity] if r.confidence == "low" else r.severity)


def test_breakdown_has_all_tiers(spark):
    found = findings(spark, [("r", "critical", "low"), ("r", "critical", "high")])
    (row,) = scoring.severity_breakdown(found, "repo_id").collect()
    assert (row.critical, row.high, row.medium, row.low) == (1, 1, 0, 0)


@pytest.mark.parametrize(("rows", "score", "label"), [
    ([], 0.0, "No Findings"),
    ([("critical", "high")], 10.0, "Medium Risk"),
    ([("high", "medium")], 3.5, "Low Risk"),
    ([("low", "low")] * 3, 1.2, "Low Risk"),
    ([("critical", "high")] * 3, 30.0, "High Risk"),
    ([("critical", "high")] * 6, 60.0, "Critical Risk"),
    ([("critical", "high")] * 500, 100.0, "Critical Risk"),
])
def test_risk(spark, rows, score, label):
    subjects = spark.createDataFrame([("r",)], "repo_id string")
    found = findings(spark, [("r", *row) for row in rows])
    (row,) = scoring.risk_labels(subjects, found, "repo_id").collect()
    assert (row.risk_score, row.risk_label) == (score, label)


def test_labels(spark):
    scores = spark.createDataFrame([(0.0,), (5.0,), (15.0,), (40.0,), (70.0,)], "s double")
    labels = [r[0] for r in scores.select(S.risk_label(F.col("s"))).collect()]
    assert labels == ["No Findings", "Low Risk", "Medium Risk", "High Risk", "Critical Risk"]


@pytest.mark.parametrize(("rows", "files", "score"), [
    ([], 10, 0), (["critical"], 50, 4), (["high"] * 10, 10, 100), (["critical"] * 500, 1, 100),
])
def test_density(spark, rows, files, score):
    scanned = spark.createDataFrame([("r",)] * files, "repo_id string")
    found = findings(spark, [("r", s, "high") for s in rows])
    (row,) = scoring.risk_density(scanned, found, "repo_id").collect()
    assert row.density_score == score


def test_normalised_severity(spark):
    raw = spark.createDataFrame([("wat",), ("CRITICAL",), (None,), ("High",)], "s string")
    out = [r[0] for r in raw.select(S.normalised_severity(F.col("s"))).collect()]
    assert out == ["low", "critical", "low", "high"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a" * 90,), ("b" * 91,)], "m string")
    assert [r[0] for r in df.select(preview(F.col("m"))).collect()] == [
        "a" * 90, "b" * 90 + "..."
    ]
    df = spark.createDataFrame([("<a href=\"x\">'&amp;",)], "m string")
    assert df.select(html_escaped(F.col("m"))).first()[0] == (
        "&lt;a href=&#34;x&#34;&gt;&#39;&amp;amp;"
    )


def test_positions_of_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40))
        .alias("g"),
        (F.col("id") * 7919 % 3001).alias("x"),
    )
    ranked = numbered_within(df, ["g"], [F.col("x")], "position").collect()
    assert len(ranked) == 3000
    groups = {}
    for row in ranked:
        groups.setdefault(row.g, []).append((row.x, row.position))
    for rows in groups.values():
        assert [p for _, p in sorted(rows)] == list(range(1, len(rows) + 1))


def test_first_of_each_group_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    top = first_within(df, ["g"], [F.col("x")], 2, "position")
    assert sorted(map(tuple, top.collect())) == [
        (0, 0, 1), (0, 3, 2), (1, 1, 1), (1, 4, 2), (2, 2, 1), (2, 5, 2)
    ]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_tiers_are_sorted_by_file_and_line(spark):
    rows = [("r", "high", "high", "b.py", 5, 0, [1], "X"),
            ("r", "high", "high", "a.py", 20, 0, [1], "Y"),
            ("r", "high", "high", "a.py", 3, 0, [1], "Z")]
    found = spark.createDataFrame(
        rows, f"{FINDING}, path string, line int, rule_seq int, pos array<int>, rule_id string")
    ranked = report.findings_by_tier(found).orderBy("position").collect()
    assert [r.rule_id for r in ranked] == ["Z", "Y", "X"]


def test_category_counts(spark):
    found = spark.createDataFrame(
        [("r", "sql"), ("r", "sql"), ("r", "crypto")], "repo_id string, rule_id string")
    rows = report.category_counts(found).orderBy("position").collect()
    assert [(r.rule_id, r.n, r.share) for r in rows] == [("sql", 2, 100.0), ("crypto", 1, 50.0)]


def test_verdicts_and_recall(spark):
    found = spark.createDataFrame(
        [("a", "x.py", 1, "r1"), ("a", "y.py", 2, "r1"), ("b", "z.py", 3, "r2")],
        "repo_id string, path string, line int, rule_id string")
    verdicts = found.withColumn(
        "verdict", F.when(F.col("line") == 1, "false_positive").otherwise("true_positive"))
    rates = {r.repo_id: r for r in evaluate.verdict_rates(found, verdicts).collect()}
    assert (rates[None].findings, rates[None].false_positive_pct) == (3, 33.3)
    assert (rates["a"].true_positive, rates["a"].true_positive_pct) == (1, 50.0)
    planted = spark.createDataFrame(
        [("a", "x.py", "c1", "r1"), ("a", "q.py", "c1", "r1"), ("b", "z.py", "c2", "r2"),
         ("b", "x.py", "same_path_elsewhere", "r1")],
        "repo_id string, path string, category string, expected_rule_id string")
    recall = {r.category: (r.planted, r.caught, r.recall_pct)
              for r in evaluate.planted_recall(planted, found).collect()}
    assert recall == {"c1": (2, 1, 50.0), "c2": (1, 1, 100.0),
                      "same_path_elsewhere": (1, 0, 0.0)}


def test_custom_rule(spark):
    from astrolake.operators import findings as fs
    from astrolake.operators.scan import Scan
    from conftest import file_table

    def asserts(nodes):
        none = F.lit(None).cast("string")
        return nodes.filter("kind = 'Assert'").select(
            "content_sha", F.lit("assert_used").alias("variant"), F.col("lineno").alias("line"),
            none.alias("func"), none.alias("recv"), none.alias("var"),
            F.lit("").alias("function_name"), F.array("depth", "pre").alias("pos"),
        )

    entry = ("assert_used", "no_asserts", "CWE-703", "low", "medium", "assert is used", "raise")
    fs.register_rule("no_asserts", Needs(("Assert",), ("content_sha", "kind", "lineno")),
                     asserts, [entry])
    try:
        files = file_table(spark, [("r", "a.py", "assert x\neval(y)")])
        rows = Scan.security(files).security_findings().collect()
        assert sorted((r.rule_id, r.line) for r in rows) == [
            ("eval_exec_misuse", 2), ("no_asserts", 1)]
    finally:
        fs.EXTRA_RULES.clear()


def test_every_finding_counts_once_whatever_its_verdicts(spark):
    keys = "repo_id string, path string, line int, rule_id string"
    found = spark.createDataFrame([("a", "x.py", 1, "r"), ("a", "x.py", 1, "r"), ("a", "y.py", 2, "r")], keys)
    verdicts = spark.createDataFrame([
        ("a", "x.py", 1, "r", "false_positive"), ("a", "x.py", 1, "r", "true_positive"),
        ("a", "y.py", 2, "r", "nuanced"), ("a", "y.py", 2, "r", "nuanced"), ("a", "y.py", 2, "r", None),
    ], keys + ", verdict string")
    total = [r for r in evaluate.verdict_rates(found, verdicts).collect() if r.repo_id is None][0]
    assert (total.findings, total.true_positive, total.nuanced, total.false_positive) == (3, 2, 1, 0)
    kept = {r.path: (r.verdict, r.conflict) for r in evaluate.settled_verdicts(verdicts).collect()}
    assert kept == {"x.py": ("true_positive", True), "y.py": ("nuanced", False)}


def test_review_sample_grows_without_redrawing_and_intervals(spark):
    found = spark.createDataFrame(
        [("a", f"p{n}.py", n, "r", 0, [n]) for n in range(50)] + [("b", "q.py", 1, "r", 0, [1])],
        "repo_id string, path string, line int, rule_id string, rule_seq int, pos array<int>")
    small, large = ({(r.repo_id, r.path): r.stratum_size for r in evaluate.review_sample(found, n).collect()}
                    for n in (3, 10))
    assert len(small) == 4 and len(large) == 11 and set(small) <= set(large)
    assert large["b", "q.py"] == 1 and {v for k, v in large.items() if k[0] == "a"} == {50}
    counts = spark.createDataFrame([(0, 10), (5, 10), (0, 0)], "n long, total long")
    got = [r[0] for r in counts.select(evaluate.rate_interval(F.col("n"), F.col("total"))).collect()]
    assert (got[0].low, got[0].high) == (0.0, 27.8) and (got[1].low, got[1].high) == (23.7, 76.3)
    assert got[2] is None
