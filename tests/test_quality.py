"""Quality checks on small sources."""

import pytest

from astrolake.operators import quality
from astrolake.operators.nodes import syntax_nodes
from astrolake.operators.scan import Scan
from conftest import file_table

BRANCHES = "".join(f"\n    if x == {i}:\n        pass" for i in range(10))
METRICS = {
    # name: ({function: (complexity, nesting)}, source)
    "flat": ({"f": (1, 0)}, "def f():\n    return 1"),
    "one_if": ({"f": (2, 1)}, "def f():\n    if a:\n        pass"),
    "bool_op": ({"f": (4, 1)}, "def f():\n    if a and b and c:\n        pass"),
    "elif_chain": ({"f": (5, 1)},
                   "def f():\n  if a:\n    pass\n  elif b:\n    pass\n  elif c:\n    pass\n"
                   "  elif d:\n    pass\n  else:\n    pass"),
    "else_block": ({"f": (2, 1)}, "def f():\n  if a:\n    pass\n  else:\n    x()"),
    "else_single_if": ({"f": (3, 1)},
                       "def f():\n  if a:\n    pass\n  else:\n    if b:\n      pass"),
    "else_if_and_more": ({"f": (3, 2)},
                         "def f():\n  if a:\n    pass\n  else:\n    if b:\n      pass\n    x()"),
    "for_if_for": ({"f": (4, 3)},
                   "def f():\n  for a in b:\n    if c:\n      for d in e:\n        pass"),
    "nested_def": ({"outer": (1, 0), "inner": (2, 1)},
                   "def outer():\n  def inner():\n    if a:\n      pass"),
    "try_except": ({"f": (3, 2)},
                   "def f():\n  try:\n    pass\n  except A:\n    if b:\n      pass"),
    "try_star": ({"f": (3, 0)},
                 "def f():\n  try:\n    if a:\n      pass\n  except* A:\n    pass"),
    "match": ({"f": (2, 0)}, "def f():\n  match a:\n    case 1:\n      if b:\n        pass"),
    "with_while": ({"f": (2, 2)}, "def f():\n  with a:\n    while b:\n      pass"),
    "expressions": ({"f": (7, 0)},
                    "def f():\n  assert a\n  x = b if c else d\n"
                    "  return [e for e in g if h if i] + [j for j in k if l or m]"),
    "lambda": ({"f": (1, 0)}, "def f():\n  return lambda: a if b else c"),
    "class_inside": ({"f": (2, 0), "m": (2, 1)},
                     "def f():\n  class C:\n    x = a if b else c\n    def m(self):\n"
                     "      if d:\n        pass"),
    "decorator_and_default": ({"f": (1, 0)},
                              "@d(a if b else c)\ndef f(x=a or b):\n  pass"),
    "async": ({"f": (2, 2)}, "async def f():\n  async with a:\n    async for b in c:\n      pass"),
}
FINDINGS = {
    # name: ([(check, line)], source)
    "complex": ([("complexity", 1)], f"def f(x):{BRANCHES}"),
    "deep": ([("nesting_depth", 1)],
             "def f():\n if a:\n  if b:\n   if c:\n    if d:\n     if e:\n      pass"),
    "at_threshold": ([], "def f():\n if a:\n  if b:\n   if c:\n    if d:\n     pass"),
    "unused": ([("unused_vars", 2)], "def f():\n    x = 1\n    return 2"),
    "used": ([], "def f():\n    x = 1\n    return x"),
    "read_before": ([], "def f():\n    g(x)\n    x = 1"),
    "underscore": ([], "def f():\n    _x = 1"),
    "tuple": ([], "def f():\n    a, b = g()"),
    "chained": ([], "def f():\n    a = b = 1"),
    "closure": ([], "def f():\n    x = 1\n    def g():\n        return x\n    return g"),
    "last_store": ([("unused_vars", 4)], "def f():\n    x = 1\n    if a:\n        x = 2"),
    "annotated": ([("unused_vars", 2)], "def f():\n    x: int = 1\n    y: int"),
    "augmented_is_no_read": ([("unused_vars", 2)], "def f():\n    x = 1\n    x += 1"),
    "delete_is_no_read": ([("unused_vars", 2)], "def f():\n    x = 1\n    del x"),
    "class_body_store": ([("unused_vars", 3)], "def f():\n    class C:\n        x = 1"),
    "decorator_reads": ([], "def f():\n    x = 1\n    @d(x)\n    def g(): pass"),
    "default_reads": ([], "def f():\n    x = 1\n    def g(a=x): pass"),
    "inner_store": ([("unused_vars", 3)], "def f():\n    def g():\n        x = 1"),
    "first_store_order": ([("unused_vars", 4), ("unused_vars", 3)],
                          "def f():\n    b = 1\n    a = 1\n    b = 2"),
    "module_store": ([], "x = 1"),
    "after_return": ([("dead_code", 3)], "def f():\n    return 1\n    g()"),
    "after_raise": ([("dead_code", 3)], "def f():\n    raise E\n    g()\n    h()"),
    "after_break": ([("dead_code", 3)], "for a in b:\n    break\n    c()"),
    "terminal_chain": ([("dead_code", 3), ("dead_code", 4)],
                       "def f():\n    return 1\n    return 2\n    g()"),
    "return_in_if": ([], "def f():\n    if a:\n        return 1\n    g()"),
    "if_false": ([("dead_code", 2)], "if False:\n    g()"),
    "if_zero": ([("dead_code", 2)], "if 0:\n    g()\nelse:\n    h()"),
    "if_none": ([("dead_code", 2)], "if None:\n    g()"),
    "if_empty": ([("dead_code", 2)], 'if "":\n    g()'),
    "if_true_else": ([("dead_code", 4)], "if True:\n    g()\nelse:\n    h()"),
    "if_true_elif": ([("dead_code", 3)], "if 1:\n    g()\nelif a:\n    h()"),
    "if_true_alone": ([], "if True:\n    g()"),
    "if_ellipsis": ([("dead_code", 4)], "if ...:\n    g()\nelse:\n    h()"),
    "while_false": ([], "while False:\n    g()"),
    "not_a_constant": ([], "if not True:\n    g()"),
    "in_handler": ([("dead_code", 5)], "try:\n  a()\nexcept E:\n  raise\n  b()"),
    "in_star_handler": ([], "try:\n  a()\nexcept* E:\n  raise\n  b()"),
    "in_star_body": ([("dead_code", 3)], "try:\n  raise E\n  b()\nexcept* E:\n  pass"),
    "in_match": ([], "def f():\n  match a:\n    case 1:\n      return 1\n      g()"),
    "finally_before_handlers": ([("dead_code", 9), ("dead_code", 6)],
                                "def f():\n  try:\n    a()\n  except E:\n    return 1\n    b()\n"
                                "  finally:\n    return 2\n    c()"),
    "if_after_return": ([("dead_code", 3), ("dead_code", 4)],
                        "def f():\n    return 1\n    if False:\n        g()"),
}


@pytest.fixture(scope="module")
def metrics(spark):
    files = file_table(spark, [(n, "a.py", s) for n, (_, s) in METRICS.items()])
    rows = files.join(quality.function_metrics(syntax_nodes(files)), "content_sha").collect()
    out = {name: {} for name in METRICS}
    for row in rows:
        out[row.repo_id][row.function_name] = (row.complexity, row.nesting)
    return out


@pytest.mark.parametrize("name", METRICS)
def test_metrics(metrics, name):
    assert metrics[name] == METRICS[name][0]


@pytest.fixture(scope="module")
def findings(scan_cases):
    return scan_cases({name: source for name, (_, source) in FINDINGS.items()})[1]


@pytest.mark.parametrize("name", FINDINGS)
def test_findings(findings, name):
    assert [(f.check, f.line) for f in findings[name]] == FINDINGS[name][0]


def test_messages(findings):
    (row,) = findings["complex"]
    assert (row.metric_value, row.function_name) == (11, "f")
    assert row.message == (
        "Function 'f' has cyclomatic complexity 11 (threshold: 10). Consider splitting it into "
        "smaller functions."
    )
    (row,) = findings["unused"]
    assert row.message == "Variable 'x' is assigned but never used in function 'f'."
    (row,) = findings["after_return"]
    assert "because line 2 unconditionally" in row.message


def test_thresholds(spark):
    files = file_table(spark, [("r", "a.py", METRICS["elif_chain"][1])])
    nodes = syntax_nodes(files)
    checks = quality.metric_findings(nodes, complexity_threshold=3, nesting_threshold=0)
    assert sorted((r.variant, r.metric_value, r.threshold) for r in checks.collect()) == [
        ("complexity", 5, 3), ("nesting_depth", 1, 0),
    ]


@pytest.mark.parametrize("check", quality.QUALITY_BUILDERS)
def test_single_checks_equal_the_full_scan(spark, findings, check):
    """A single check reads fewer rows, and visits fewer nodes, than a full scan."""
    files = file_table(spark, [(name, "sample_module.py", s) for name, (_, s) in FINDINGS.items()])
    got = sorted((r.repo_id, r.line, r.message) for r in Scan(files).check(check).collect())
    wanted = {"dead_after": "because line", "dead_branch": "condition is always"}
    name = "dead_code" if check in wanted else check
    expected = sorted(
        (case, r.line, r.message) for case, rows in findings.items() for r in rows
        if r.check == name and wanted.get(check, "") in r.message
    )
    assert got == expected
    assert got


def test_thresholds_and_dead_code_by_name(spark):
    text = "def f(x):\n    if x:\n        return 1\n        x = 2\n    if False:\n        pass\n"
    scan = Scan(file_table(spark, [("r", "a.py", text)]))
    assert scan.check("complexity").count() == 0
    (row,) = scan.check("complexity", threshold=2).collect()
    assert (row.metric_value, "(threshold: 2)" in row.message) == (3, True)
    assert scan.check("nesting_depth", threshold=0).count() == 1
    assert sorted(r.line for r in scan.check("dead_code").collect()) == [4, 6]
    with pytest.raises(ValueError, match="no threshold"):
        scan.check("dead_code", threshold=1)
    with scan:
        checks = {r.check for r in scan.quality_findings(complexity_threshold=2).collect()}
    assert checks == {"complexity", "unused_vars", "dead_code"} - {"unused_vars"}


def test_repository_without_a_parsed_file_has_no_score(spark):
    with Scan.full(file_table(spark, [("r", "a.py", "def f(:")])) as scan:
        (row,) = scan.dashboard().collect()
    assert (row.files_parsed, row.risk_score, row.risk_label) == (0, None, None)
