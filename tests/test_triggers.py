"""The text filter in front of the parser must never lose a finding."""

import pytest

from astrolake import fixed_values
from astrolake.fixed_values import SECURITY_RULES
from astrolake.operators import quality
from astrolake.operators.nodes import syntax_nodes
from astrolake.operators.scan import Scan
from astrolake.operators.triggers import may_fire, may_note
from conftest import file_table
from test_quality import FINDINGS, METRICS
from test_rules import FIRES, FUNCTIONS, SILENT
from test_taint import CASES

ODD = {
    "full_width": "ｅｖａｌ(x)",
    "utf_7": b"# coding: utf-7\n+AGU-val(x)\n",
    "bom": b"\xef\xbb\xbfeval(x)",
    "continued": "os.\\\nsystem(f'{x}')",
    "in_fstring": "f'{eval(x)}'",
}


@pytest.fixture(scope="module")
def files(spark):
    cases = {name: case[4] for name, case in FIRES.items()} | SILENT | ODD
    cases |= {f"fn_{name}": source for name, (_, source) in FUNCTIONS.items()}
    cases |= {f"taint_{name}": source for name, (_, source) in CASES.items()}
    return file_table(spark, [(name, "a.py", text) for name, text in cases.items()])


@pytest.fixture(scope="module")
def everything(files):
    rows = Scan.full(files).security_findings(snippets=False).collect()
    return sorted((r.rule_id, r.repo_id, r.line, r.pos) for r in rows)


def test_odd_spellings_are_found(everything):
    assert set(ODD) <= {repo for _, repo, _, _ in everything}


def test_security_scan(files, everything):
    rows = Scan.security(files).security_findings(snippets=False).collect()
    assert sorted((r.rule_id, r.repo_id, r.line, r.pos) for r in rows) == everything


@pytest.mark.parametrize("rule", SECURITY_RULES)
def test_single_rules(files, everything, rule):
    rows = Scan(files).rule(rule).collect()
    found = sorted((r.rule_id, r.repo_id, r.line, r.pos) for r in rows)
    assert found == [row for row in everything if row[0] == rule]


def test_triggers_follow_the_lists(spark, monkeypatch):
    files = file_table(spark, [("r", "a.py", "cursor.run_sql(f'{x}')"), ("r", "b.py", "x = 1")])
    assert files.filter(may_fire(("sql_injection",))).count() == 0
    monkeypatch.setattr(fixed_values, "SQL_METHODS", (*fixed_values.SQL_METHODS, "run_sql"))
    assert [r.path for r in files.filter(may_fire(("sql_injection",))).collect()] == ["a.py"]


def test_triggers_need_no_patterns(spark):
    """Alternatives cost megabytes of text many times what a search for bytes does."""
    plan = file_table(spark, [("r", "a.py", "x = 1")]).filter(may_fire(SECURITY_RULES))
    assert "RLIKE" not in plan._jdf.queryExecution().optimizedPlan().toString().upper()


@pytest.mark.parametrize("text, kept", [
    ("My_PassWord = 1", True), ("x = KEY", True), ("Eval(x)", False), ("OPEN(INPUT())", False),
    ("eval(x)", True), ("x = 'é'", True), (b"\xff", True), ("# coding", True), ("", False),
    ("input()", False), ("input(open(x))", True), ("os.popen(x)", True), ("x = 1", False),
])
def test_words_of_triggers(spark, text, kept):
    """Only the markers of secrets are found in any case; bytes that are not ASCII keep a text."""
    files = file_table(spark, [("r", "a.py", text)])
    assert files.filter(may_fire(SECURITY_RULES)).count() == kept


DEAD = {
    "next_line": "def f():\n    return 1\n    g()",
    "comments": "def f():\n    return 1  # it's (\n\n  # a\n    # b\n    g()",
    "semicolon": "def f():\n    return 1; g()",
    "before_semicolon": "def f():\n    g(); return 1\n    h()",
    "brackets": "def f():\n    return (1,\n2)\n    g()",
    "string": 'def f():\n    return """a"b\n"""\n    g()',
    "field": "def f():\n    return f'{\n1}'\n    g()",
    "nested_field": 'def f():\n    return f"{f"{\n1}"}"\n    g()',
    "continued": "def f():\n    return \\\n1\n    g()",
    "tabs": "while a:\n \t\tbreak\n\t \tc()",
    "mac_lines": "def f():\r    return 1\r    g()",
    "top": "return\ng()",
    "deep_brackets": "def f():\n    return ((((((1))))))\n    g()",
    "full_width": "def ｆ():\n    raise E\n    g()",
}
ALIVE = {
    "last": "def f():\n    return g(x)[1]('a', [x])\n\n\ndef h():\n    return 'it'\n",
    "lower": "for a in b:\n    if a:\n        continue\n    c()\n    raise E  # (",
    "inline": "for a in b:\n    if a: break\n    c()\nreturned = 1\nx = 2",
}
DEEP = {
    "spaces": "def f():\n if a:\n  for b in c:\n   with d:\n    try:\n     while e: pass\n    finally: pass",
    "tabs": "async def f():\n\tif a:\n\t\tpass\n\telif b:\n\t\tif c:\n\t\t\tif d:\n\t\t\t\tasync with e:\n"
            "\t\t\t\t\tasync for g in h: pass",
    "continued": "def f():\n if a:\n  if b:\n   if c:\n    if d:\n     \\\nif e: pass",
    "mac_lines": "def f():\r if a:\r  if b:\r   if c:\r    if d:\r     if e: pass",
}
FLAT = {
    "four": "def f():\n if a:\n  if b:\n   if c:\n    if d: pass",
    "wide": "def f():\n" + "".join(f"    if x:\n        for y in z: pass\n" for _ in range(9)),
    "module": "if a:\n pass",
}


@pytest.mark.parametrize("check, fires, silent", [
    ("dead_after", DEAD, ALIVE), ("nesting_depth", DEEP, FLAT),
])
def test_quality_checks(spark, check, fires, silent):
    """No finding is lost, and texts that cannot give one are not parsed."""
    cases = {**fires, **silent}
    files = file_table(spark, [(name, "a.py", text) for name, text in cases.items()])
    assert {r.repo_id for r in Scan(files).check(check).collect()} == set(fires)
    limit = quality.THRESHOLDS.get(check, 0)
    kept = {r.repo_id for r in files.filter(may_note(check, limit)).select("repo_id").collect()}
    assert kept == set(fires)


def test_quality_checks_of_all_cases(spark):
    """The cases of the other tests, and long lines, which must not exhaust a stack."""
    long = ["[" + "'a', (1), " * 200_000 + "]", "(" * 90 + "1" + ")" * 90]
    cases = {**{f"m_{n}": c[1] for n, c in METRICS.items()}, **{f"f_{n}": c[1] for n, c in FINDINGS.items()},
             **DEAD, **DEEP, "long": f"def f():\n    return {long[0]}\n", "nested": f"def f():\n    return {long[1]}\n",
             "blank": "def f():\n    return 1\n" + "#\n\n" * 200_000 + "    g()"}
    files = file_table(spark, [(name, "a.py", text) for name, text in cases.items()])
    for check in ("dead_after", "nesting_depth"):
        needs, build = quality.QUALITY_BUILDERS[check]
        whole = build(syntax_nodes(files, needs))
        part = build(syntax_nodes(files.filter(may_note(check, quality.THRESHOLDS.get(check, 0))), needs))
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))
    whole = quality.function_metrics(syntax_nodes(files, quality.METRIC_NEEDS))
    deep = Scan(files).check("nesting_depth", 0).count()
    assert deep == whole.where("nesting > 0").join(files, "content_sha").count()
