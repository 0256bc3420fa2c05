"""Which files a rule or a check can fire on, decided on the raw text before anything is parsed.

A rule fires only where certain identifiers stand.  In plain ASCII text without a coding
declaration an identifier can only be spelled literally, so a file without those words cannot give
a finding and need not be shuffled or parsed.  Text with other bytes is kept: there the parser
normalises identifiers, and a declared codec may hide them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from astrolake import fixed_values as V

LITERAL, ANY_CASE = "literal", "any_case"


def _any(*names: str, case: str = LITERAL) -> tuple[str, tuple[str, ...]]:
    """How the names are compared, and those of them that hold no other: where a longer name stands,
    the shorter one does."""
    names = tuple(dict.fromkeys(name.lower() if case == ANY_CASE else name for name in names))
    return case, tuple(n for n in names if not any(m != n and m in n for m in names))


def triggers() -> dict[str, tuple[tuple[str, tuple[str, ...]], ...]]:
    """Rule id -> groups of words, of each of which one must occur somewhere in the text, from the
    lists the rules use.

    `subprocess`, `yaml`, `hashlib`, `random`, `MODE_ECB`, `input`, `get` and `join` are names the
    predicates test for themselves.
    """
    shell = _any(*V.OS_SHELL_FUNCTIONS, "subprocess")
    source = _any("input", "get")
    return {
        "sql_injection": (_any(*V.SQL_METHODS),),
        "command_injection": (shell,),
        "hardcoded_secrets": (_any(*V.SENSITIVE_NAME_MARKERS, case=ANY_CASE),),
        "insecure_deserialization": (_any(*V.PICKLE_MODULES, "yaml"),),
        "weak_crypto": (_any("hashlib", *V.WEAK_CIPHER_MODULES, "MODE_ECB", "random"),),
        "missing_input_validation": (
            source, _any(*V.SENSITIVE_SINK_FUNCTIONS, *V.SENSITIVE_SINK_METHODS)),
        "path_traversal": (source, _any(*V.PATH_SINK_FUNCTIONS, "join")),
        "eval_exec_misuse": (_any(*V.CODE_EXECUTION_FUNCTIONS),),
        "command_injection_taint": (shell,),
    }


def may_fire(rules: tuple[str, ...]) -> Column | None:
    """Filter on `content`; None when some rule gives no triggers.

    Words are looked for byte by byte, which costs a text of megabytes about a tenth of what a
    pattern of alternatives does.
    """
    known = triggers()
    if not all(rule in known for rule in rules):
        return None
    chosen = tuple(dict.fromkeys(known[rule] for rule in rules))
    content = F.col("content")
    forms = {LITERAL: content.cast("string")}
    if any(case == ANY_CASE for groups in chosen for case, _ in groups):
        forms[ANY_CASE] = F.lower(forms[LITERAL])

    def fires(text: Column) -> Column:
        return reduce(or_, [
            reduce(and_, [
                reduce(or_, [F.contains(text[case], F.lit(name)) for name in names])
                for case, names in groups
            ])
            for groups in chosen
        ])

    return _where_plain(forms, fires)


def _where_plain(forms: dict[str, Column], test: Callable[[Column], Column]) -> Column:
    """`test` of the given forms of the content, or that the content may hold names in other
    spellings: bytes that are not ASCII, or a coding declaration."""
    content = F.col("content")
    # Read as one character per byte, every byte that is not ASCII takes two bytes in UTF-8.
    other = F.octet_length(F.decode(content, "ISO-8859-1")) != F.octet_length(content)
    # The array of one holds the forms of a text for all tests.
    return F.exists(
        F.array(F.struct(other.alias("other"), *(form.alias(case) for case, form in forms.items()))),
        lambda text: text["other"] | F.contains(text[LITERAL], F.lit("coding")) | test(text))


# A statement that may hold blocks and counts as nesting, with the blanks in front of it.
_NESTS = r"(?m)^([ \t\f]++)(?:if|elif|for|while|try|with|async)\b"


def _rest_of_line(depth: int) -> str:
    """Pattern of code that ends with its line for certain: simple strings, and brackets that close,
    at most `depth` in each other.  All loops are possessive, which Java runs without recursion."""
    inside = _rest_of_line(depth - 1) if depth else ""
    brackets = rf"|\({inside}\)|\[{inside}\]|\{{{inside}\}}" if depth else ""
    return rf"""(?:[^\n"'#()\[\]{{}}]++|"[^"\n]*+"|'[^'\n]*+'{brackets})*+"""


_TERMINAL = r"(?md)^( *+)(?:return|raise|break|continue)\b"
# Code at the same indentation behind the line, blank lines and comments aside.
_FOLLOWED = _TERMINAL + r"[^\n]*+\n(?: *+(?:#[^\n]*+)?\n)*+\1[^ #\n]"
# The statement may reach beyond its line: brackets, triple quotes, or fields of a formatted string.
_REACHES_ON = _TERMINAL + (
    r"""(?:(?=[^\n]*?(?:\"{3}|'{3}))|(?=[^\n]*?\{)(?=[^\n]*?["'])|"""
    rf"(?!{_rest_of_line(4)}(?:#[^\n]*+)?$))")
# Several statements on a line, continued lines, and blanks whose width depends on their order.
_UNUSUAL = (";", "\\", "\t", "\f", "\r")


def may_note(check: str, threshold: int) -> Column | None:
    """Filter on `content` for a quality check; None where every text may give a finding.

    Only texts that cannot give one fall out.  Blocks nested n deep begin on lines of n different
    indentations.  A statement behind a terminal one stands on its line, behind a semicolon, or at the
    same indentation on the next line that has code.
    """
    def nests(text: Column) -> Column:
        blanks = F.regexp_extract_all(text[LITERAL], F.lit(_NESTS), F.lit(1))
        return F.contains(text[LITERAL], F.lit("def")) & (
            (F.size(F.array_distinct(blanks)) > threshold) | F.contains(text[LITERAL], F.lit("\\")))

    def follows(text: Column) -> Column:
        unusual = reduce(or_, [F.contains(text[LITERAL], F.lit(sign)) for sign in _UNUSUAL])
        return unusual | text[LITERAL].rlike(_FOLLOWED) | text[LITERAL].rlike(_REACHES_ON)

    tests = {"nesting_depth": nests, "dead_after": follows}
    if check not in tests:
        return None
    return _where_plain({LITERAL: F.col("content").cast("string")}, tests[check])
