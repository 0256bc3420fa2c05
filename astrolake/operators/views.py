"""Relational views over the node table.

Operands are stored beside their node, so no view needs a parent-child join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.fixed_values import FUNCTION_KINDS
from astrolake.functions import predicates as P
from astrolake.functions.predicates import of_kind
from astrolake.operators.nodes import LINE, Needs
from astrolake.session import spread

CALLS = Needs(("Call",), (
    "content_sha", "kind", "pre", "last", "depth", "lineno", "func_kind", "func_name", "recv_kind",
    "recv_name", "recv_root", "args", "kws", "fns", "events",
))
FUNCTIONS = Needs(FUNCTION_KINDS, (
    "content_sha", "kind", "pre", "last", "depth", "lineno", "ident", "params", "own_fn",
))
ASSIGNS = Needs(("Assign",), (
    "content_sha", "kind", "pre", "depth", "lineno", "targets", "value", "own_fn", "flow",
))
LINES = Needs((LINE,), ("content_sha", "kind", "lineno", "text"))
KIND_COUNTS = Needs((), ("kind",))


def _named(rows: DataFrame, columns: str, renamed: dict[str, str]) -> DataFrame:
    """The given columns as far as the nodes hold them (`Needs.only` leaves some out), renamed."""
    kept = [name for name in columns.split() if name in rows.columns]
    return rows.select(*(F.col(name).alias(renamed.get(name, name)) for name in kept))


def calls(nodes: DataFrame) -> DataFrame:
    return _named(
        nodes.filter(of_kind("Call")),
        "content_sha pre last depth lineno func_kind func_name recv_kind recv_name recv_root args "
        "kws fns events", {"lineno": "line"})


def functions(nodes: DataFrame) -> DataFrame:
    """Every `def` and `async def` at any depth, with its parameters."""
    return _named(
        nodes.filter(of_kind(*FUNCTION_KINDS)),
        "content_sha pre last depth lineno ident params own_fn",
        {"lineno": "line", "ident": "function_name"})


def assigns(nodes: DataFrame) -> DataFrame:
    return _named(
        nodes.filter(of_kind("Assign")),
        "content_sha pre depth lineno targets value own_fn flow", {"lineno": "line"})


def with_text(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls or assignments with the stripped line each begins on, of any length.  The nodes must
    hold `LINES` too."""
    lines = nodes.filter(of_kind(LINE)).select(
        "content_sha", F.col("lineno").alias("line"), "text"
    )
    return rows.join(spread(lines), ["content_sha", "line"], "left")


def dynamic_strings(nodes: DataFrame) -> DataFrame:
    """Calls whose first argument is a string put together at run time."""
    return calls(nodes).filter(P.is_dynamic_first_arg())


def user_input_calls(nodes: DataFrame) -> DataFrame:
    return calls(nodes).filter(P.is_user_input())


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("kind").startswith("#")).groupBy("kind").agg(
        F.count("*").alias("n")
    )
