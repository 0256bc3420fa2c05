"""Security rules that look at a whole function: input source, sink and safeguard in its walk.

Both rules share one aggregation by (content, function).  Only marked rows enter it, and the rows
of a function leave one parse task, so the map side already folds them to one row per function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.functions import predicates as P
from astrolake.functions.predicates import of_kind
from astrolake.operators.nodes import Needs, rows_of

FUNCTION_RULE_NEEDS = Needs(("Call", "Compare"), (
    "content_sha", "kind", "pre", "depth", "lineno", "func_kind", "func_name", "recv_kind",
    "recv_name", "recv_root", "args", "cmp_ops", "fns",
))

# rule id -> (variant, sink predicate, safeguard predicate)
FUNCTION_RULES = {
    "missing_input_validation": ("unvalidated_input", P.is_sensitive_sink, P.is_validation),
    "path_traversal": ("unchecked_path", P.is_path_sink, P.is_path_safety_check),
}


def function_marks(nodes: DataFrame, rules=tuple(FUNCTION_RULES)) -> DataFrame:
    """Rows (content, function, flags) for every function whose walk holds a marked node.  A node
    counts for each function around it, decorators and defaults included."""
    marks = [P.is_user_input().alias("source")]
    for rule in rules:
        _, sink, safeguard = FUNCTION_RULES[rule]
        marks += [sink().alias(f"{rule}_sink"), safeguard().alias(f"{rule}_safe")]
    names = ["source", *(f"{rule}_{part}" for rule in rules for part in ("sink", "safe"))]
    any_mark = F.lit(False)
    for name in names:
        any_mark = any_mark | F.col(name)
    return (
        rows_of(nodes, *FUNCTION_RULE_NEEDS.kinds)
        .filter(of_kind(*FUNCTION_RULE_NEEDS.kinds) & P.may_be_marked())
        .filter(F.size("fns") > 0)
        .select("content_sha", "fns", "depth", "pre", "lineno", *marks)
        .filter(any_mark)
        .select("content_sha", F.explode("fns").alias("fn"), "depth", "pre", "lineno",
                *names)
    )


def first_in_walk(condition: Column) -> Column:
    """Line of the first matching node in breadth-first order, which is not always the smallest.  Depth
    and number make one number: the least struct would need rows sorted by function."""
    place = F.shiftleft(F.col("depth").cast("long"), 32) + F.col("pre")
    return F.min_by("lineno", F.when(condition, place))


def function_findings(nodes: DataFrame, rules=tuple(FUNCTION_RULES)) -> DataFrame:
    aggregates = [F.bool_or("source").alias("source")]
    for rule in rules:
        aggregates += [
            first_in_walk(F.col(f"{rule}_sink")).alias(f"{rule}_sink"),
            F.bool_or(f"{rule}_safe").alias(f"{rule}_safe"),
        ]
    per_function = function_marks(nodes, rules).groupBy("content_sha", "fn").agg(*aggregates)
    hits = [
        F.when(
            F.col(f"{rule}_sink").isNotNull() & ~F.col(f"{rule}_safe"),
            F.struct(
                F.lit(FUNCTION_RULES[rule][0]).alias("variant"),
                F.col(f"{rule}_sink").alias("line"),
            ),
        )
        for rule in rules
    ]
    return (
        per_function.filter("source")
        .withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
        .select(
            "content_sha", "hit.variant", "hit.line",
            F.lit(None).cast("string").alias("func"), F.lit(None).cast("string").alias("recv"),
            F.lit(None).cast("string").alias("var"), F.col("fn.name").alias("function_name"),
            F.array("fn.depth", "fn.pre").alias("pos"),
        )
    )
