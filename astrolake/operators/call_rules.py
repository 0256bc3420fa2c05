"""Security rules that look at one call or one assignment.

All of them are decided in one pass over the node rows, without a shuffle: a row turns into the
array of findings it gives rise to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.fixed_values import (
    CODE_EXECUTION_FUNCTIONS,
    OS_SHELL_FUNCTIONS,
    PICKLE_FUNCTIONS,
    PICKLE_MODULES,
    RANDOM_FUNCTIONS,
    SQL_METHODS,
    SUBPROCESS_FUNCTIONS,
    WEAK_CIPHER_MODULES,
    WEAK_HASH_FUNCTIONS,
)
from astrolake.functions import predicates as P
from astrolake.functions.predicates import of_kind
from astrolake.operators.nodes import Needs, rows_of

# What each node kind contributes to these rules.
CALL_RULE_NEEDS = {
    "Call": Needs(("Call",), (
        "content_sha", "kind", "pre", "depth", "lineno", "func_kind", "func_name", "recv_kind",
        "recv_name", "args", "kws", "value",
    )),
    "Assign": Needs(("Assign",), (
        "content_sha", "kind", "pre", "depth", "lineno", "func_name", "recv_name", "targets",
        "value",
    )),
}


def sql_injection() -> Column:
    dynamic = P.has_args() & P.is_dynamic_first_arg()
    return F.when(P.calls_method(*SQL_METHODS) & dynamic, "sql_dynamic")


def command_injection() -> Column:
    dynamic = P.has_args() & P.is_dynamic_first_arg()
    return (
        F.when(P.is_shell_call() & dynamic, "shell_dynamic")
        .when(P.is_subprocess_shell_call() & dynamic, "shell_dynamic")
        .when(P.is_subprocess_shell_call(), "shell_flag")
    )


def insecure_deserialization() -> Column:
    return (
        F.when(P.calls_module(PICKLE_MODULES, PICKLE_FUNCTIONS), "pickle_load")
        .when(P.calls_module(("yaml",), ("unsafe_load",)), "yaml_unsafe_load")
        .when(P.calls_module(("yaml",), ("load",)) & ~P.has_safe_loader(), "yaml_load")
    )


def weak_crypto_call() -> Column:
    return (
        F.when(P.calls_module(("hashlib",), WEAK_HASH_FUNCTIONS), "weak_hash")
        .when(P.calls_module(WEAK_CIPHER_MODULES, ("new",)), "weak_cipher")
        .when(P.has_ecb_argument(), "ecb_mode")
    )


def eval_exec_misuse() -> Column:
    called = P.calls_name(*CODE_EXECUTION_FUNCTIONS) & P.has_args()
    literal = P.is_literal_first_arg()
    return F.when(called & literal, "eval_literal").when(called, "eval_dynamic")


def weak_random() -> Column:
    """For a sensitive target name: the value is directly `random.<function>()`."""
    drawn = P.holds(
        f"value.call_recv = 'random' AND {P.among('value.call_attr', RANDOM_FUNCTIONS)}"
    )
    return F.when(drawn, "random_secret")


def hardcoded_secret(min_length: int = 1) -> Column:
    """For a sensitive target name: the value is a string literal, by default any but the empty."""
    literal = P.holds(
        f"value.const_type = 'str' AND length(value.const_str) >= {min_length}"
    )
    return F.when(literal, "secret_literal")


# rule id -> (node kind it reads, expression giving the catalog variant or NULL)
CALL_RULES = {
    "sql_injection": [("Call", sql_injection)],
    "command_injection": [("Call", command_injection)],
    "hardcoded_secrets": [("Assign", hardcoded_secret)],
    "insecure_deserialization": [("Call", insecure_deserialization)],
    "weak_crypto": [("Call", weak_crypto_call), ("Assign", weak_random)],
    "eval_exec_misuse": [("Call", eval_exec_misuse)],
}
# Function names a rule can fire on.  Most calls fail this test and cost nothing more.
CALLED_NAMES = {
    "sql_injection": SQL_METHODS,
    "command_injection": (*OS_SHELL_FUNCTIONS, *SUBPROCESS_FUNCTIONS),
    "insecure_deserialization": (*PICKLE_FUNCTIONS, "unsafe_load"),
    "weak_crypto": (*WEAK_HASH_FUNCTIONS, "new"),
    "eval_exec_misuse": CODE_EXECUTION_FUNCTIONS,
}


def _may_fire(rules: tuple[str, ...]) -> Column:
    names = [name for rule in rules for name in CALLED_NAMES.get(rule, ())]
    calls = F.expr(P.among("func_name", names)) if names else F.lit(False)
    if "weak_crypto" in rules:
        calls = calls | P.has_ecb_argument()
    assigns = F.expr(
        f"value.const_type = 'str' OR {P.among('value.call_attr', RANDOM_FUNCTIONS)}"
    )
    return (of_kind("Call") & calls) | (of_kind("Assign") & assigns)

_HIT = "struct<variant:string,var:string,at:int>"


def _hits(rules: list, kind: str) -> Column:
    """Array of (variant, variable, target number) for a row of `kind`."""
    variants = [build() for wanted, build in rules if wanted == kind]
    none = F.array().cast(f"array<{_HIT}>")
    if not variants:
        return none
    fired = F.filter(F.array(*variants), lambda v: v.isNotNull())
    if kind == "Call":
        found = F.transform(fired, lambda v: F.struct(
            v.alias("variant"), F.lit(None).cast("string").alias("var"), F.lit(0).alias("at")
        ))
    else:
        # One finding per sensitive target; a value fires at most one of the rules.
        named = F.transform(F.col("targets"), lambda t, i: F.struct(
            F.get(fired, F.lit(0)).alias("variant"), t["ident"].alias("var"), i.alias("at")
        ))
        found = F.when(F.size(fired) > 0, F.filter(named, lambda t: P.is_sensitive_name(t["var"])))
    return F.when(of_kind(kind), found.cast(f"array<{_HIT}>")).otherwise(none)


def call_findings(nodes: DataFrame, rules=tuple(CALL_RULES)) -> DataFrame:
    """Findings of the given rules, one row each, still at the grain of distinct contents."""
    chosen = [entry for rule in rules for entry in CALL_RULES[rule]]
    kinds = sorted({kind for kind, _ in chosen})
    hits = F.concat(*[_hits(chosen, kind) for kind in kinds])
    func = F.coalesce(F.col("func_name"), F.col("value")["call_attr"])
    return (
        rows_of(nodes, *kinds).filter(of_kind(*kinds) & _may_fire(tuple(rules)))
        .withColumn("hit", F.explode(hits))
        .select(
            "content_sha", F.col("hit.variant").alias("variant"), F.col("lineno").alias("line"),
            func.alias("func"), F.col("recv_name").alias("recv"), F.col("hit.var").alias("var"),
            F.lit("").alias("function_name"),
            F.array("depth", "pre", "hit.at").alias("pos"),
        )
    )
