"""Findings against labels: coverage, verdict rates, recall on planted weaknesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.operators.ranking import first_within
from astrolake.session import spread


def rule_coverage_gap(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Expected (repo, rule) pairs without any finding.  Findings fold to distinct pairs first."""
    found = findings.select("repo_id", "rule_id").distinct()
    return expected.join(spread(found), ["repo_id", "rule_id"], "left_anti")


def _percent(part: Column) -> Column:
    return F.round(part * 100.0 / F.col("findings"), 1)


FINDING_KEYS = ["repo_id", "path", "line", "rule_id"]
# Where reviewers disagree, the verdict further to the right holds: a weakness someone has confirmed
# is not argued away.
VERDICT_KINDS = ("false_positive", "nuanced", "true_positive")


def settled_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per (repository, path, line, rule), by the order of `VERDICT_KINDS`; other texts
    count below all of them, a missing verdict is none.  `conflict` tells whether reviewers
    disagreed."""
    rank = F.array_position(F.array(*map(F.lit, VERDICT_KINDS)), F.col("verdict"))
    best = F.max(F.struct(rank.alias("rank"), "verdict"))
    return verdicts.filter(F.col("verdict").isNotNull()).groupBy(*FINDING_KEYS).agg(
        best["verdict"].alias("verdict"),
        (F.min("verdict") != F.max("verdict")).alias("conflict"),
    )


def verdict_rates(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts and percentages of manual verdicts per repository, and one total row (NULL).

    Every finding counts once, whatever the number of verdicts on it; two findings of a rule on one
    line share the verdict on that line and count once each."""
    keys, kinds = FINDING_KEYS, VERDICT_KINDS
    judged = findings.select(*keys).join(spread(settled_verdicts(verdicts)), keys)
    return (
        judged.rollup("repo_id")
        .agg(
            F.count("*").alias("findings"),
            *[F.count_if(F.col("verdict") == kind).alias(kind) for kind in kinds],
        )
        .select(
            "repo_id", "findings", *kinds,
            *[_percent(F.col(kind)).alias(f"{kind}_pct") for kind in kinds],
        )
    )


def review_sample(findings: DataFrame, per_stratum: int, by: tuple[str, ...] = ("repo_id", "rule_id"),
                  seed: str = "") -> DataFrame:
    """The findings a reviewer should look at: of each stratum the `per_stratum` with the least digest
    of seed, path and line.  The draw is the same in every run and grows without redrawing: a larger
    sample holds the smaller one.  `position` numbers the draw, `stratum_size` counts the stratum.
    Only the chosen rows of a stratum leave a task."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), "path", F.col("line").cast("string")))
    sizes = findings.groupBy(*by).agg(F.count("*").alias("stratum_size"))
    drawn = first_within(findings.withColumn("_draw", draw), list(by),
                         [F.col("_draw"), F.col("path"), F.col("line"), F.col("rule_seq"), F.col("pos")],
                         per_stratum, "position")
    return drawn.drop("_draw").join(sizes, list(by))


def rate_interval(part: Column, total: Column, z: float = 1.96) -> Column:
    """(low, high) of a share in percent, one decimal: Wilson's interval, which holds for small
    samples and shares near 0 and 1.  Null where nothing was judged."""
    share, scale = part / total, 1 + z * z / total
    middle = (share + z * z / (2 * total)) / scale
    spread = F.sqrt(share * (1 - share) / total + z * z / (4 * total * total)) * z / scale
    return F.when(total > 0, F.struct(
        F.round(F.greatest(middle - spread, F.lit(0.0)) * 100, 1).alias("low"),
        F.round(F.least(middle + spread, F.lit(1.0)) * 100, 1).alias("high")))


def planted_recall(planted: DataFrame, findings: DataFrame) -> DataFrame:
    """Planted weaknesses caught by the rule that should see them, per category.  Paths repeat
    across repositories, so both sides meet on the repository too."""
    keys = ["repo_id", "path", "expected_rule_id"]
    found = (
        findings.select("repo_id", "path", F.col("rule_id").alias("expected_rule_id"))
        .distinct()
        .withColumn("caught", F.lit(1))
    )
    return (
        planted.join(spread(found), keys, "left")
        .groupBy("category")
        .agg(
            F.count("*").alias("planted"),
            F.count("caught").alias("caught"),
            F.round(F.count("caught") * 100.0 / F.count("*"), 1).alias("recall_pct"),
        )
    )
