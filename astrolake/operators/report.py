"""Tables of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolake.fixed_values import SEVERITIES, TOP_FINDINGS
from astrolake.functions import severity as S
from astrolake.functions.text import html_escaped, preview
from astrolake.operators import scoring
from astrolake.operators.ranking import first_within, numbered_within
from astrolake.session import spread


def findings_by_tier(findings: DataFrame) -> DataFrame:
    """Findings of each repository, grouped by effective tier, in (path, line) order."""
    ranked = scoring.with_effective_severity(findings).withColumn(
        "tier", S.severity_rank(F.col("effective_severity"))
    )
    order = [F.col("path"), F.col("line"), F.col("rule_seq"), F.col("pos")]
    return numbered_within(ranked, ["repo_id", "tier"], order, "position")


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings per rule and repository, with the share of the largest category.  The window runs
    over one row per rule."""
    counts = findings.groupBy("repo_id", "rule_id").agg(
        F.sum(scoring.times(findings)).alias("n")
    )
    largest = Window.partitionBy("repo_id")
    order = largest.orderBy(F.desc("n"), "rule_id")
    return counts.select(
        "repo_id", "rule_id", "n", F.row_number().over(order).alias("position"),
        F.round(F.col("n") / F.max("n").over(largest) * 100, 1).alias("share"),
    )


def quality_by_check(quality: DataFrame) -> DataFrame:
    """Quality findings per repository and check, in (path, line) order."""
    order = [F.col("path"), F.col("line"), F.col("pos")]
    return numbered_within(quality, ["repo_id", "check_seq"], order, "position")


def check_counts(quality: DataFrame, *by: str) -> DataFrame:
    return quality.groupBy(*by, "check").agg(F.sum(scoring.times(quality)).alias("n"))


def top_findings(quality: DataFrame, limit: int = TOP_FINDINGS) -> DataFrame:
    """First findings of each repository in scan order: file, check, walk order."""
    order = [F.col("path"), F.col("check_seq"), F.col("pos")]
    return first_within(quality, ["repo_id"], order, limit, "position")


def message_previews(findings: DataFrame) -> DataFrame:
    return findings.withColumn("preview", preview(F.col("message")))


def escaped(findings: DataFrame) -> DataFrame:
    """Message and snippet as they may stand in a page."""
    return findings.withColumn("message", html_escaped(F.col("message"))).withColumn(
        "code_snippet", html_escaped(F.col("code_snippet"))
    )


def parse_summary(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files found, parsed and failed per repository.  Copies fold before the join."""
    owners = files.groupBy("repo_id", "content_sha").agg(F.count("*").alias("n"))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return owners.join(spread(status), "content_sha", "left").groupBy("repo_id").agg(
        F.sum("n").alias("files_found"),
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("files_parsed"),
        F.sum(F.when(ok, 0).otherwise(F.col("n"))).alias("files_failed"),
    )


def parse_failures(files: DataFrame, status: DataFrame) -> DataFrame:
    failed = status.filter(~F.col("ok")).select("content_sha", "parse_error")
    return files.select("repo_id", "path", "content_sha").join(spread(failed), "content_sha").select(
        "repo_id", "path", "parse_error"
    )


def dashboard(files: DataFrame, status: DataFrame, security: DataFrame,
              quality: DataFrame) -> DataFrame:
    """One row per repository, from findings or from counted findings.  They are folded to one row
    per repository before any join.  A repository without a single parsed file was not scanned: its
    score and label are null."""
    return dashboard_of(parse_summary(files, status), security, quality)


def dashboard_of(summary: DataFrame, security: DataFrame, quality: DataFrame) -> DataFrame:
    """`dashboard` from the files of each repository counted by `parse_summary`."""
    times = scoring.times(security)
    risk = scoring.with_effective_severity(security).groupBy("repo_id").agg(
        F.sum(times).alias("security_findings"),
        scoring.sum_of_tenths(times),
        *scoring.tier_counts(times),
    )
    notes = quality.groupBy("repo_id").agg(F.sum(scoring.times(quality)).alias("quality_findings"))
    score = F.when(F.col("files_parsed") > 0, S.risk_score(F.col("tenths")))
    label = F.when(F.col("files_parsed") > 0, S.risk_label(S.risk_score(F.col("tenths"))))
    counts = ["security_findings", "quality_findings", *SEVERITIES]
    return (
        summary
        .join(risk, "repo_id", "left")
        .join(notes, "repo_id", "left")
        .select(
            "repo_id", "files_found", "files_parsed", "files_failed",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            score.alias("risk_score"), label.alias("risk_label"),
        )
    )
