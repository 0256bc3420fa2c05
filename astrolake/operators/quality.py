"""Code-quality checks: complexity, nesting, unused variables, dead code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.fixed_values import (
    BRANCH_KINDS,
    COMPLEXITY_THRESHOLD,
    FUNCTION_KINDS,
    NESTING_KINDS,
    NESTING_THRESHOLD,
    TERMINAL_KINDS,
)
from astrolake.functions import predicates as P
from astrolake.functions.predicates import of_kind
from astrolake.operators.nodes import FUNCTION, READ, Needs, rows_of

METRIC_NEEDS = Needs(
    tuple(dict.fromkeys(
        (*FUNCTION_KINDS, *BRANCH_KINDS, "BoolOp", "comprehension", *NESTING_KINDS)
    )),
    ("content_sha", "kind", "pre", "depth", "lineno", "ident", "n_list", "nest", "own_fn"),
)
NAME_NEEDS = Needs(("Assign", "AnnAssign", READ), (
    "content_sha", "kind", "pre", "lineno", "ident", "ctx", "targets", "value", "own_fn",
    "body_fns",
))
DEAD_NEEDS = Needs((*TERMINAL_KINDS, "If"), (
    "content_sha", "kind", "lineno", "next_line", "block_key", "value", "body_line", "else_line",
))


def _none(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def _decision_weight() -> Column:
    return (
        F.when(of_kind(*BRANCH_KINDS), 1)
        .when(of_kind("BoolOp"), F.col("n_list") - 1)
        .when(of_kind("comprehension"), F.col("n_list"))
        .otherwise(0)
    )


def function_metrics(nodes: DataFrame) -> DataFrame:
    """Cyclomatic complexity and nesting depth of every function.

    One hash aggregation by (content, function): the definition itself brings the base values, so
    that a flat function has a row too, and no join back to the definitions is needed.
    """
    is_def = of_kind(*FUNCTION_KINDS)
    itself = F.struct("depth", "pre", F.col("ident").alias("name")).cast(FUNCTION)
    fn = F.when(is_def, itself).otherwise(F.col("own_fn"))
    depth = F.when(is_def, 0).when(of_kind(*NESTING_KINDS), F.col("nest") + 1)
    return (
        rows_of(nodes, *METRIC_NEEDS.kinds).filter(of_kind(*METRIC_NEEDS.kinds))
        .select(
            "content_sha", fn.alias("fn"),
            F.when(is_def, 1).otherwise(_decision_weight()).alias("weight"),
            depth.alias("depth"), F.when(is_def, F.col("lineno")).alias("line"),
        )
        .filter(F.col("fn").isNotNull())
        .groupBy("content_sha", "fn")
        .agg(
            F.sum("weight").cast("int").alias("complexity"),
            F.max("depth").alias("nesting"),
            F.max("line").alias("line"),
        )
        .select("content_sha", "line", F.col("fn.name").alias("function_name"), "complexity",
                "nesting", F.array("fn.depth", "fn.pre").alias("pos"))
    )


def metric_findings(
    nodes: DataFrame,
    complexity_threshold: int = COMPLEXITY_THRESHOLD,
    nesting_threshold: int = NESTING_THRESHOLD,
    checks: tuple[str, ...] = ("complexity", "nesting_depth"),
) -> DataFrame:
    """Functions above a threshold; both checks come from the same aggregation."""
    def over(check: str, metric: str, threshold: int) -> Column:
        hit = F.struct(
            F.lit(check).alias("variant"), F.col(metric).alias("metric"),
            F.lit(threshold).alias("threshold"),
        )
        return F.when(F.col(metric) > threshold, hit)

    rules = {
        "complexity": over("complexity", "complexity", complexity_threshold),
        "nesting_depth": over("nesting_depth", "nesting", nesting_threshold),
    }
    hits = F.filter(F.array(*[rules[c] for c in checks]), lambda h: h.isNotNull())
    return (
        function_metrics(nodes)
        .withColumn("hit", F.explode(hits))
        .select("content_sha", "hit.variant", "line", "function_name",
                F.col("hit.metric").alias("metric_value"), "hit.threshold",
                _none("string").alias("var"), _none("int").alias("after"), "pos")
    )


def unused_vars(nodes: DataFrame) -> DataFrame:
    """Simple stores whose name is never read in the function.

    Stores count for the function they belong to, reads for every function whose body holds them.
    Stores and reads meet in one hash aggregation by (content, function, name): numbers only, so it
    folds on the map side, and a name read a million times in one file is one row there.
    """
    target = F.get("targets", F.lit(0))
    simple = (
        (F.size("targets") == 1)
        & (target["kind"] == "Name")
        & ~target["ident"].startswith("_")
        & F.col("value").isNotNull()
        & F.col("own_fn").isNotNull()
    )
    place = F.col("pre").cast("long") * F.lit(1 << 32) + F.col("lineno")
    store = of_kind("Assign", "AnnAssign") & simple
    read = of_kind("Name") & (F.col("ctx") == "Load") & (F.size("body_fns") > 0)
    return (
        rows_of(nodes, *NAME_NEEDS.kinds).filter(store | read)
        .select(
            "content_sha",
            F.explode(F.when(store, F.array("own_fn")).otherwise(F.col("body_fns"))).alias("fn"),
            F.when(store, target["ident"]).otherwise(F.col("ident")).alias("var"),
            F.when(store, place).alias("place"),
            read.alias("read"),
        )
        .groupBy("content_sha", "fn", "var")
        .agg(F.max("place").alias("last"), F.min("place").alias("first"),
             F.bool_or("read").alias("read"))
        .filter(~F.col("read"))
        .select(
            "content_sha", F.lit("unused_vars").alias("variant"),
            (F.col("last") % F.lit(1 << 32)).cast("int").alias("line"),
            F.col("fn.name").alias("function_name"), F.lit(0).alias("metric_value"),
            _none("int").alias("threshold"), "var", _none("int").alias("after"),
            F.array("fn.depth", "fn.pre",
                    F.shiftright(F.col("first"), 32).cast("int")).alias("pos"),
        )
    )


def _after_terminal() -> Column:
    """A statement right behind return, raise, break or continue in a reached block.  Every row
    knows the line of its next sibling, so no window over blocks is needed."""
    return (
        of_kind(*TERMINAL_KINDS) & F.col("block_key").isNotNull() & F.col("next_line").isNotNull()
    )


def _never() -> Column:
    return P.value_is_constant(truthy=False)


def _constant_branch() -> Column:
    """Body of an `if` on a false constant, `else` of one on a true constant."""
    always = P.value_is_constant(truthy=True) & F.col("else_line").isNotNull()
    return of_kind("If") & F.col("block_key").isNotNull() & (_never() | always)


def dead_code(nodes: DataFrame, after: bool = True, branch: bool = True) -> DataFrame:
    """Both kinds of unreachable code, or one of them, in one pass: a row is of one kind at most."""
    key = F.col("block_key")
    is_branch, never = of_kind("If"), _never()
    follower = F.concat(
        F.slice(key, 1, F.size(key) - 1), F.array(F.element_at(key, -1) + 1, F.lit(-2)))
    wanted = F.lit(False)
    for condition, chosen in ((_after_terminal(), after), (_constant_branch(), branch)):
        wanted = wanted | condition if chosen else wanted
    kinds = (*(TERMINAL_KINDS if after else ()), *(("If",) if branch else ()))
    return rows_of(nodes, *kinds).filter(wanted).select(
        "content_sha",
        F.when(~is_branch, "dead_after").when(never, "dead_if").otherwise("dead_else")
        .alias("variant"),
        F.when(~is_branch, F.col("next_line")).when(never, F.col("body_line"))
        .otherwise(F.col("else_line")).alias("line"),
        F.lit("").alias("function_name"), F.lit(0).alias("metric_value"),
        _none("int").alias("threshold"), _none("string").alias("var"),
        F.when(~is_branch, F.col("lineno")).alias("after"),
        F.when(is_branch, F.concat(key, F.array(F.lit(-1)))).otherwise(follower).alias("pos"),
    )


def dead_after_terminal(nodes: DataFrame) -> DataFrame:
    return dead_code(nodes, branch=False)


def dead_constant_branch(nodes: DataFrame) -> DataFrame:
    return dead_code(nodes, after=False)


# check -> (what it reads, builder)
def complexity(nodes: DataFrame, threshold: int = COMPLEXITY_THRESHOLD) -> DataFrame:
    return metric_findings(nodes, complexity_threshold=threshold, checks=("complexity",))


def nesting_depth(nodes: DataFrame, threshold: int = NESTING_THRESHOLD) -> DataFrame:
    return metric_findings(nodes, nesting_threshold=threshold, checks=("nesting_depth",))


THRESHOLDS = {"complexity": COMPLEXITY_THRESHOLD, "nesting_depth": NESTING_THRESHOLD}
QUALITY_BUILDERS = {
    "complexity": (METRIC_NEEDS, complexity),
    "unused_vars": (NAME_NEEDS, unused_vars),
    "nesting_depth": (METRIC_NEEDS, nesting_depth),
    "dead_code": (DEAD_NEEDS, dead_code),
    "dead_after": (DEAD_NEEDS, dead_after_terminal),
    "dead_branch": (DEAD_NEEDS, dead_constant_branch),
}
QUALITY_NEEDS = METRIC_NEEDS | NAME_NEEDS | DEAD_NEEDS


def quality_content_findings(nodes: DataFrame, **thresholds: int) -> DataFrame:
    """All checks, at the grain of distinct contents."""
    parts = [metric_findings(nodes, **thresholds), unused_vars(nodes), dead_code(nodes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
