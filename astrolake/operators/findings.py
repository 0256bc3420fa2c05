"""From content-level hits to findings of files.

A hit knows its content and catalog variant.  Here it is joined back to every file with that
content, and gets its texts, severity and confidence: whether a file is a test depends on its path,
so severity can only be set after this join.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.fixed_values import (
    QUALITY_CHECKS,
    OS_SHELL_FUNCTIONS,
    QUALITY_MESSAGES,
    RANDOM_FUNCTIONS,
    SECURITY_CATALOG,
    SECURITY_RULES,
    SUBPROCESS_FUNCTIONS,
)
from astrolake.functions.predicates import ECB_MODE, MARKED_NAMES, of_kind
from astrolake.functions.text import filled
from astrolake.operators import quality
from astrolake.operators.call_rules import (
    CALL_RULE_NEEDS,
    CALL_RULES,
    CALLED_NAMES,
    call_findings,
)
from astrolake.operators.function_rules import (
    FUNCTION_RULE_NEEDS,
    FUNCTION_RULES,
    function_findings,
)
from astrolake.operators.nodes import LINE, Needs, Uses, rows_of
from astrolake.operators.taint import TAINT_NEEDS, taint_findings
from astrolake.session import spread

TAINT_RULE = "command_injection_taint"
LINE_NEEDS = Needs((LINE,), ("content_sha", "kind", "lineno", "text"))

# Rules added by a user: rule id -> (what it reads, hits builder, catalog entries)
EXTRA_RULES: dict[str, tuple[Needs, Callable, list[tuple]]] = {}


def register_rule(rule_id: str, needs: Needs, hits: Callable, catalog: list[tuple]):
    """Add a rule: `hits(nodes)` returns rows shaped like those of `call_findings`, whose variants
    are described by `catalog` entries (variant, rule, CWE, severity, confidence, message, fix)."""
    EXTRA_RULES[rule_id] = (needs, hits, list(catalog))


def all_rules() -> tuple[str, ...]:
    return (*SECURITY_RULES, *EXTRA_RULES)


def rule_needs(rules: tuple[str, ...] | None = None, snippets: bool = True) -> Needs:
    """Part of the node table the given rules read, all rules by default."""
    needs = LINE_NEEDS if snippets else Needs((), ())
    for rule in rules or all_rules():
        if rule in CALL_RULES:
            for kind, _ in CALL_RULES[rule]:
                needs |= CALL_RULE_NEEDS[kind]
        elif rule in FUNCTION_RULES:
            needs |= FUNCTION_RULE_NEEDS
        elif rule == TAINT_RULE:
            needs |= TAINT_NEEDS
        else:
            needs |= EXTRA_RULES[rule][0]
    return needs


def uses() -> Uses | None:
    """What all rules and checks use of the rows they need; None with rules added by a user."""
    if EXTRA_RULES:
        return None
    return Uses(
        called=frozenset((*(name for names in CALLED_NAMES.values() for name in names),
                          *MARKED_NAMES, *OS_SHELL_FUNCTIONS, *SUBPROCESS_FUNCTIONS)),
        passed=frozenset((ECB_MODE,)),
        drawn=frozenset(RANDOM_FUNCTIONS),
        sinks=(*OS_SHELL_FUNCTIONS, "subprocess"),
    )


def rule_catalog(spark: SparkSession) -> DataFrame:
    """Dimension of finding texts: the fixed handful of catalog entries.  Its size does not depend
    on the data, so it is always broadcast; a shuffle on so few keys would be badly skewed."""
    order = {rule: number for number, rule in enumerate(all_rules())}
    entries = [*SECURITY_CATALOG, *(e for _, _, extra in EXTRA_RULES.values() for e in extra)]
    names = ("variant", "rule_id", "cwe_id", "base_severity", "base_confidence", "template",
             "fix_suggestion")
    columns = {name: [e[at] for e in entries] for at, name in enumerate(names)}
    sequence = pa.array([order[e[1]] for e in entries], type=pa.int32())
    return F.broadcast(spark.createDataFrame(pa.table({**columns, "rule_seq": sequence})))


def security_hits(nodes: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """Hits of the chosen rules.  Nothing is de-duplicated between rules."""
    chosen = tuple(rules) if rules else all_rules()
    parts = []
    by_call = tuple(r for r in chosen if r in CALL_RULES)
    by_function = tuple(r for r in chosen if r in FUNCTION_RULES)
    if by_call:
        parts.append(call_findings(nodes, by_call))
    if by_function:
        parts.append(function_findings(nodes, by_function))
    if TAINT_RULE in chosen:
        parts.append(taint_findings(nodes))
    parts += [EXTRA_RULES[r][1](nodes) for r in chosen if r in EXTRA_RULES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_snippets(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stripped source line of each hit.  A line is stored once per content, whatever its length
    and however many calls stand on it, and looked up here."""
    lines = rows_of(nodes, LINE).filter(of_kind(LINE)).select(
        "content_sha", F.col("lineno").alias("line"), "text"
    )
    return hits.join(spread(lines), ["content_sha", "line"], "left").withColumn(
        "code_snippet", F.coalesce("text", F.lit(""))
    ).drop("text")


def security_findings(
    files: DataFrame, nodes: DataFrame, rules: tuple[str, ...] | None = None,
    snippets: bool = True,
) -> DataFrame:
    hits = security_hits(nodes, rules)
    hits = with_snippets(hits, nodes) if snippets else hits.withColumn("code_snippet", F.lit(""))
    owners = files.select("repo_id", "path", "is_test", "content_sha")
    message = filled(
        F.col("template"), func=F.col("func"), recv=F.col("recv"), var=F.col("var"),
        function=F.col("function_name"),
    )
    # Function rules name their function; call rules leave the column empty.
    return (
        owners.join(spread(hits), "content_sha")
        .join(rule_catalog(files.sparkSession), "variant")
        .select(
            "repo_id", "rule_id", "cwe_id",
            F.when(F.col("is_test"), "low").otherwise(F.col("base_severity")).alias("severity"),
            "path", "line", message.alias("message"), "fix_suggestion", "code_snippet",
            F.when(F.col("is_test"), "low").otherwise(F.col("base_confidence"))
            .alias("confidence"),
            "function_name", "rule_seq", "pos",
        )
    )


def _owner_counts(files: DataFrame) -> DataFrame:
    """Files per (repository, content, test flag): however often a content is copied inside a
    repository, it is one row here."""
    return files.groupBy("repo_id", "content_sha", "is_test").agg(F.count("*").alias("n_files"))


def security_counts(files: DataFrame, nodes: DataFrame, rules: tuple[str, ...] | None = None):
    """(repo_id, rule_id, severity, confidence, n) without listing the findings.

    Hits fold to one row per content and variant and files to one row per repository and content
    before they meet, so a content copied into a third of all files does not multiply its findings
    in the join.
    """
    hits = security_hits(nodes, rules).groupBy("content_sha", "variant").agg(
        F.count("*").alias("n_hits")
    )
    return (
        _owner_counts(files)
        .join(spread(hits), "content_sha")
        .join(rule_catalog(files.sparkSession), "variant")
        .select(
            "repo_id", "rule_id",
            F.when(F.col("is_test"), "low").otherwise(F.col("base_severity")).alias("severity"),
            F.when(F.col("is_test"), "low").otherwise(F.col("base_confidence"))
            .alias("confidence"),
            (F.col("n_files") * F.col("n_hits")).alias("n"),
        )
        .groupBy("repo_id", "rule_id", "severity", "confidence")
        .agg(F.sum("n").alias("n"))
    )


def _check() -> Column:
    variant = F.col("variant")
    return F.when(variant.startswith("dead_"), "dead_code").otherwise(variant)


def quality_counts(files: DataFrame, hits: DataFrame) -> DataFrame:
    """(repo_id, check, n), folded the same way."""
    per_content = hits.groupBy("content_sha", _check().alias("check")).agg(
        F.count("*").alias("n_hits")
    )
    owners = files.groupBy("repo_id", "content_sha").agg(F.count("*").alias("n_files"))
    return (
        owners.join(spread(per_content), "content_sha")
        .groupBy("repo_id", "check")
        .agg(F.sum(F.col("n_files") * F.col("n_hits")).alias("n"))
    )


def quality_findings(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Files joined to hits of the quality checks."""
    owners = files.select("repo_id", "path", "content_sha")
    variant = F.col("variant")
    template = F.lit(None).cast("string")
    for name, text in QUALITY_MESSAGES.items():
        template = F.when(variant == name, text).otherwise(template)
    message = filled(
        template, function=F.col("function_name"), metric=F.col("metric_value"),
        threshold=F.col("threshold"), var=F.col("var"), after=F.col("after"),
    )
    sequence = F.array_position(F.array(*map(F.lit, QUALITY_CHECKS)), F.col("check"))
    return (
        owners.join(spread(hits), "content_sha")
        .withColumn("check", _check())
        .select("repo_id", "check", "path", "line", message.alias("message"), "function_name",
                "metric_value", (sequence.cast("int") - 1).alias("check_seq"), "pos")
    )


def all_quality_findings(files: DataFrame, nodes: DataFrame, **thresholds: int) -> DataFrame:
    return quality_findings(files, quality.quality_content_findings(nodes, **thresholds))
