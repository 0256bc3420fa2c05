"""Predicates over rows of the node table.

All are built-in SQL expressions.  They are written as SQL text, since a rule set holds hundreds of
small expressions and each costs one call to the JVM this way.  Unknown counts as false.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from astrolake.fixed_values import (
    OS_SHELL_FUNCTIONS,
    PATH_SAFETY_METHODS,
    PATH_SINK_FUNCTIONS,
    REQUEST_INPUT_ATTRIBUTES,
    SENSITIVE_NAME_MARKERS,
    SENSITIVE_SINK_FUNCTIONS,
    SENSITIVE_SINK_METHODS,
    SUBPROCESS_FUNCTIONS,
    VALIDATION_FUNCTIONS,
    VALIDATION_METHODS,
    YAML_SAFE_LOADERS,
)

FIRST_ARGUMENT = "get(args, 0)"
ECB_MODE = "MODE_ECB"


def holds(condition: str) -> Column:
    return F.expr(f"coalesce({condition}, false)")


def among(field: str, names: Iterable[str]) -> str:
    """SQL membership test against fixed names."""
    return f"{field} IN ({', '.join(map(repr, names))})"


def of_kind(*kinds: str) -> Column:
    return F.expr(among("kind", kinds))


# --- calls ----------------------------------------------------------------------------------

def calls_name(*names: str) -> Column:
    return holds(f"func_kind = 'Name' AND {among('func_name', names)}")


def calls_method(*names: str) -> Column:
    """Attribute call on any receiver."""
    return holds(f"func_kind = 'Attribute' AND {among('func_name', names)}")


def calls_module(modules: Iterable[str], functions: Iterable[str]) -> Column:
    """`module.function(...)` on the plain module name; aliases are not resolved."""
    return holds(
        f"func_kind = 'Attribute' AND {among('func_name', functions)} "
        f"AND recv_kind = 'Name' AND {among('recv_name', modules)}"
    )


def has_args() -> Column:
    return holds("size(args) > 0")


def is_literal_first_arg() -> Column:
    return holds(f"{FIRST_ARGUMENT}.const_type = 'str'")


def keyword_is_true(name: str) -> Column:
    """The first constant value given for the keyword is `True` itself."""
    first = f"get(filter(kws, k -> k.name = '{name}' AND k.const_type IS NOT NULL), 0)"
    return holds(f"{first}.const_type = 'bool' AND {first}.const_truthy")


def has_ecb_argument() -> Column:
    is_ecb = f"x -> coalesce(x.kind = 'Attribute' AND x.ident = '{ECB_MODE}', false)"
    return holds(f"exists(args, {is_ecb})") | holds(f"exists(kws, {is_ecb})")


def has_safe_loader() -> Column:
    safe = f"k.kind IN ('Name', 'Attribute') AND {among('k.ident', YAML_SAFE_LOADERS)}"
    return holds(f"exists(kws, k -> coalesce(k.name = 'Loader' AND {safe}, false))")


def is_shell_call() -> Column:
    return calls_module(("os",), OS_SHELL_FUNCTIONS)


def is_subprocess_shell_call() -> Column:
    return calls_module(("subprocess",), SUBPROCESS_FUNCTIONS) & keyword_is_true("shell")


def is_shell_sink() -> Column:
    return is_shell_call() | is_subprocess_shell_call()


def is_user_input() -> Column:
    """`input(...)` or `<anything>.<request attribute>.get(...)`."""
    return calls_name("input") | holds(
        "func_kind = 'Attribute' AND func_name = 'get' AND recv_kind = 'Attribute' "
        f"AND {among('recv_name', REQUEST_INPUT_ATTRIBUTES)}"
    )


def is_sensitive_sink() -> Column:
    return calls_name(*SENSITIVE_SINK_FUNCTIONS) | calls_method(*SENSITIVE_SINK_METHODS)


def is_path_sink() -> Column:
    return calls_name(*PATH_SINK_FUNCTIONS) | holds(
        "func_kind = 'Attribute' AND func_name = 'join' AND recv_kind = 'Attribute' "
        "AND recv_name = 'path' AND recv_root = 'os'"
    )


# Names of calls the function rules can use.
MARKED_NAMES = tuple(dict.fromkeys((
    "input", "get", "join", *SENSITIVE_SINK_FUNCTIONS, *SENSITIVE_SINK_METHODS,
    *PATH_SINK_FUNCTIONS, *VALIDATION_FUNCTIONS, *VALIDATION_METHODS, *PATH_SAFETY_METHODS,
)))


def may_be_marked() -> Column:
    """Cheap test for rows the function rules can use; it reaches the Parquet scan."""
    return F.expr(f"kind = 'Compare' OR {among('func_name', MARKED_NAMES)}")


# --- comparisons ----------------------------------------------------------------------------

def tests_membership() -> Column:
    return holds("exists(cmp_ops, op -> op IN ('In', 'NotIn'))")


def is_validation() -> Column:
    return (
        calls_name(*VALIDATION_FUNCTIONS) | calls_method(*VALIDATION_METHODS) | tests_membership()
    )


def is_path_safety_check() -> Column:
    looks_at_parent = holds(
        "kind = 'Compare' AND exists(args, x -> coalesce(x.const_str = '..', false))"
    )
    return calls_method(*PATH_SAFETY_METHODS) | (looks_at_parent & tests_membership())


# --- operands and names ---------------------------------------------------------------------

def is_dynamic_first_arg() -> Column:
    """f-string, `%`, `.format()`, or `+` next to something that may be a string."""
    x = FIRST_ARGUMENT
    stringy = "s.kind IN ('BinOp', 'JoinedStr', 'Call') OR coalesce(s.const_type = 'str', false)"
    return holds(
        f"coalesce({x}.kind = 'JoinedStr', false) OR coalesce({x}.op = 'Mod', false) "
        f"OR coalesce({x}.op = 'Add' AND exists({x}.sides, s -> {stringy}), false) "
        f"OR coalesce({x}.call_attr = 'format', false)"
    )


def is_sensitive_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(SENSITIVE_NAME_MARKERS)), F.lit(False))


def value_is_constant(truthy: bool) -> Column:
    return holds(f"value.const_type IS NOT NULL AND value.const_truthy = {truthy}")
