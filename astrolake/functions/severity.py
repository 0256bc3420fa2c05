"""Column functions of the severity model.  Scores are counted in whole tenths, so that sums are
exact and do not depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from astrolake.fixed_values import (
    CONFIDENCE_TENTHS,
    DENSITY_FACTOR,
    ONE_TIER_DOWN,
    RISK_CAP,
    RISK_LABEL_ABOVE_ZERO,
    RISK_LABEL_ZERO,
    RISK_LABELS,
    SEVERITIES,
    SEVERITY_WEIGHTS,
)


def _lookup(key: Column, table: dict) -> Column:
    (first, value), *rest = table.items()
    out = F.when(key == first, F.lit(value))
    for name, value in rest:
        out = out.when(key == name, F.lit(value))
    return out


def effective_severity(severity: Column, confidence: Column) -> Column:
    """Low confidence shows a finding one tier lower."""
    return F.when(confidence == "low", _lookup(severity, ONE_TIER_DOWN)).otherwise(severity)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, {name: rank for rank, name in enumerate(SEVERITIES)})


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_WEIGHTS)


def risk_tenths(severity: Column, confidence: Column) -> Column:
    return severity_weight(severity) * _lookup(confidence, CONFIDENCE_TENTHS)


def risk_score(sum_of_tenths: Column) -> Column:
    capped = F.least(F.coalesce(sum_of_tenths, F.lit(0)), F.lit(RISK_CAP * 10))
    return capped.cast("double") / F.lit(10.0)


def risk_label(score: Column) -> Column:
    out = None
    for floor, label in RISK_LABELS:
        out = F.when(score >= floor, label) if out is None else out.when(score >= floor, label)
    return out.when(score > 0, RISK_LABEL_ABOVE_ZERO).otherwise(RISK_LABEL_ZERO)


def density_score(sum_of_weights: Column, files: Column) -> Column:
    """Weight per scanned file, scaled to 0..100."""
    dense = F.bround(sum_of_weights.cast("double") / files * DENSITY_FACTOR, 0)
    return F.least(F.lit(RISK_CAP), F.coalesce(dense, F.lit(0.0)).cast("int"))


def density_label(score: Column) -> Column:
    """Label of the lowest and the highest density score; the bands between are not known."""
    return F.when(score == 0, RISK_LABEL_ABOVE_ZERO).when(
        score == RISK_CAP, RISK_LABELS[0][1])


def normalised_severity(raw: Column) -> Column:
    """Any case; unknown or missing counts as low."""
    lowered = F.lower(raw)
    return F.when(lowered.isin(*SEVERITIES), lowered).otherwise(F.lit("low"))
