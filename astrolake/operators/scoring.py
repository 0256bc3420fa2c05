"""Scores and counts over findings.  Every aggregation combines on the map side, so a repository
that holds a third of all findings costs its reducer one row per map task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.fixed_values import SEVERITIES
from astrolake.functions import severity as S


def with_effective_severity(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "effective_severity", S.effective_severity(F.col("severity"), F.col("confidence"))
    )


def times(findings: DataFrame) -> Column:
    """Findings a row stands for: rows of counted findings carry the number in `n`."""
    return F.col("n") if "n" in findings.columns else F.lit(1)


def tier_counts(each: Column) -> list[Column]:
    """One column per effective tier, 0 where a tier is empty."""
    return [
        F.sum(F.when(F.col("effective_severity") == tier, each).otherwise(0)).alias(tier)
        for tier in SEVERITIES
    ]


def severity_breakdown(findings: DataFrame, *by: str) -> DataFrame:
    tiers = tier_counts(times(findings))
    return with_effective_severity(findings).groupBy(*by).agg(*tiers)


def sum_of_tenths(each: Column) -> Column:
    """Weight times confidence, in tenths, on the severity the rule assigned."""
    return F.sum(S.risk_tenths(F.col("severity"), F.col("confidence")) * each).alias("tenths")


def risk_tenths(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(sum_of_tenths(times(findings)))


def risk_score(findings: DataFrame, *by: str) -> DataFrame:
    return risk_tenths(findings, *by).select(
        *by, S.risk_score(F.col("tenths")).alias("risk_score")
    )


def risk_labels(subjects: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Score and label of every subject, also of those without findings."""
    scored = subjects.select(by).distinct().join(risk_tenths(findings, by), by, "left")
    score = S.risk_score(F.col("tenths"))
    return scored.select(by, score.alias("risk_score"), S.risk_label(score).alias("risk_label"))


def risk_density(files: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Weight per file; both sides are one row per group before they meet."""
    weights = findings.groupBy(by).agg(
        F.sum(S.severity_weight(S.normalised_severity(F.col("severity")))).alias("weight")
    )
    counts = files.groupBy(by).agg(F.count("*").alias("files_scanned"))
    score = S.density_score(F.col("weight"), F.col("files_scanned"))
    return counts.join(weights, by, "left").select(
        by, "files_scanned", score.alias("density_score"),
        S.density_label(score).alias("density_label"),
    )
