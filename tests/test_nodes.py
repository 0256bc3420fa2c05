"""Node table against plain loops over the trees of real modules, and the parse job's edge cases."""

import ast
import collections
import dataclasses
import inspect
import io
import json.decoder
import subprocess
import textwrap
import tokenize
import typing
from collections import Counter

import pytest
from pyspark.sql import functions as F

from astrolake.operators import nodes as N
from astrolake.operators import quality, report, views
from conftest import file_table

MODULES = (ast, collections, dataclasses, inspect, json.decoder, subprocess, textwrap, typing)
FOLDED = (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


@pytest.fixture(scope="module")
def sources():
    return {m.__name__: open(m.__file__, "rb").read() for m in MODULES}


@pytest.fixture(scope="module")
def modules(spark, sources):
    files = file_table(spark, [("std", name, raw) for name, raw in sources.items()])
    owners = files.select("path", "content_sha")
    nodes = owners.join(N.syntax_nodes(files), "content_sha").persist()
    yield nodes
    nodes.unpersist()


def trees(sources):
    return {name: ast.parse(raw) for name, raw in sources.items()}


def functions_of(tree):
    return [n for n in ast.walk(tree) if isinstance(n, DEFS)]


def test_walk_order(modules, sources):
    rows = modules.filter(~F.col("kind").startswith("#")).orderBy("path", "depth", "pre")
    got = {}
    for row in rows.select("path", "kind", "lineno").collect():
        got.setdefault(row.path, []).append((row.kind, row.lineno))
    for name, tree in trees(sources).items():
        expected = [
            (type(n).__name__, getattr(n, "lineno", None))
            for n in ast.walk(tree) if not isinstance(n, FOLDED)
        ]
        assert got[name] == expected


def test_nested_sets(modules, sources):
    sizes = {
        (r.path, r.lineno, r.ident): r["last"] - r["pre"] + 1
        for r in modules.filter(F.col("kind").isin("FunctionDef", "ClassDef")).collect()
    }
    for name, tree in trees(sources).items():
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                inside = sum(not isinstance(n, FOLDED) for n in ast.walk(node))
                assert sizes[name, node.lineno, node.name] == inside


def test_calls_in_walk(modules, sources):
    counts = modules.filter(F.col("kind") == "Call").select("path", F.explode("fns").alias("fn"))
    got = Counter((r.path, r.fn.name) for r in counts.collect())
    expected = Counter()
    for name, tree in trees(sources).items():
        for fn in functions_of(tree):
            expected[name, fn.name] += sum(isinstance(n, ast.Call) for n in ast.walk(fn))
    assert got == +expected


def test_reads_in_body(modules, sources):
    reads = modules.filter((F.col("kind") == "Name") & (F.col("ctx") == "Load"))
    got = Counter(
        (r.path, r.fn.name, r.ident)
        for r in reads.select("path", F.explode("body_fns").alias("fn"), "ident").collect()
    )
    expected = Counter()
    for name, tree in trees(sources).items():
        for fn in functions_of(tree):
            for statement in fn.body:
                for n in ast.walk(statement):
                    if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                        expected[name, fn.name, n.id] += 1
    assert got == expected


def brute_metrics(fn):
    """(complexity, nesting) by a plain stack over (node, depth or None)."""
    complexity, deepest = 1, 0
    stack = [(statement, 0) for statement in fn.body]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, (*DEFS, ast.Lambda)):
            continue
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler,
                             ast.IfExp, ast.Assert)):
            complexity += 1
        complexity += len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0
        complexity += len(node.ifs) if isinstance(node, ast.comprehension) else 0
        control = isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With,
                                    ast.AsyncWith))
        if control and depth is not None:
            deepest = max(deepest, depth + 1)
        for field, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if not isinstance(child, ast.AST):
                    continue
                below = None
                if depth is not None and isinstance(child, (ast.stmt, ast.excepthandler)):
                    if isinstance(node, ast.ExceptHandler):
                        below = depth
                    elif control:
                        chained = (field == "orelse" and isinstance(node, ast.If)
                                   and len(value) == 1 and isinstance(child, ast.If))
                        below = depth if chained else depth + 1
                stack.append((child, below))
    return complexity, deepest


def test_metrics_of_real_code(modules, sources):
    metrics = quality.function_metrics(modules.drop("path"))
    owners = modules.select("path", "content_sha").distinct()
    got = {
        (r.path, r.line, r.function_name): (r.complexity, r.nesting)
        for r in owners.join(metrics, "content_sha").collect()
    }
    expected = {
        (name, fn.lineno, fn.name): brute_metrics(fn)
        for name, tree in trees(sources).items() for fn in functions_of(tree)
    }
    assert got == expected


def test_needs_prune_rows_and_columns(spark, sources):
    files = file_table(spark, [("std", "a.py", sources["textwrap"])])
    nodes = N.syntax_nodes(files, N.Needs(("Call",), ("content_sha", "lineno", "func_name")))
    assert nodes.columns == ["content_sha", "lineno", "func_name"]
    whole = views.calls(N.syntax_nodes(files)).select("content_sha", "line", "func_name")
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, whole.collect()))


def test_copies_are_parsed_once(spark):
    copy = "import os\ndef f(x):\n    os.system(x)"
    rows = [("hot", f"d{i}/m.py", copy) for i in range(300)]
    rows += [("other", f"m{i}.py", f"x = {i}") for i in range(300)]
    files = file_table(spark, rows)
    assert N.distinct_contents(files).count() == 301
    assert N.syntax_nodes(files).filter("kind = 'Module'").count() == 301
    from astrolake.operators.scan import Scan
    found = Scan.security(files).security_findings()
    assert found.count() == 300
    assert found.select("path").distinct().count() == 300


FILES = [
    ("bom", b"\xef\xbb\xbfprint('hi')\n", None),
    ("latin", "# -*- coding: latin-1 -*-\nx = 'é'\n".encode("latin-1"), None),
    ("crlf", b"x = 1\r\ny = 2\r\n", None),
    ("empty", b"", None),
    ("surrogate", rb"x = '\ud800'", None),
    ("syntax", b"def broken(:\n    pass", "SyntaxError at line 1: invalid syntax"),
    ("not_utf8", b"x = '\xff'", "Could not read file: "),
    ("codec", b"# coding: no-such-codec\n", "Could not read file: unknown encoding"),
    ("null", b"x = 1\x00", "SyntaxError at line None: source code string cannot contain null"),
    ("deep", b"x = " + b"(" * 300 + b")" * 300, "SyntaxError at line 1"),
    ("long_chain", b"x = a" + b".b" * 900, None),
    ("many_terms", b"x = " + b" + ".join([b"a"] * 900), None),
]


def test_status_of_every_file(spark):
    files = file_table(spark, [("r", name, raw) for name, raw, _ in FILES])
    status = N.parse_status(N.syntax_nodes(files, N.STATUS))
    rows = files.join(status, "content_sha", "left").collect()
    errors = {r.path: r.parse_error for r in rows}
    assert len(rows) == len(FILES)
    for name, _, expected in FILES:
        if expected is None:
            assert errors[name] is None
        else:
            assert errors[name].startswith(expected)
    assert {r.path: r.ok for r in rows} == {name: e is None for name, _, e in FILES}
    (summary,) = report.parse_summary(files, status).collect()
    failed = sum(e is not None for _, _, e in FILES)
    assert (summary.files_found, summary.files_parsed, summary.files_failed) == (
        len(FILES), len(FILES) - failed, failed
    )


def test_source_lines(spark):
    files = file_table(spark, [
        ("r", "a.py", b"\xef\xbb\xbfx = 1\r\n\r\ny = 2\x0cz = 3\n"), ("r", "b.py", b""),
    ])
    lines = files.join(N.source_lines(files), "content_sha").orderBy("line")
    assert [(r.path, r.line, r.text) for r in lines.collect()] == [
        ("a.py", 1, "x = 1"), ("a.py", 2, ""), ("a.py", 3, "y = 2"), ("a.py", 4, "z = 3"),
    ]


def test_source_lines_equal_python(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["", "\n", "a", "a\n\n", "\n\r", "\r\n\r\n", " \t", "x = 'é\U0001f600'\n#\n"]
    texts += [f"a{end}b{end}{end}c{end}" for end in ends] + ["".join(ends), "\n" * 5 + "z"]
    raws = [text.encode() for text in texts] + [b"\xef\xbb\xbf" + t.encode() for t in texts]
    raws += [
        b"# coding: latin-1\nx = '\xe9'\n", b"\n# -*- coding: cp1252 -*-\ny = '\x80'\n",
        b"\n\n# coding: latin-1\nx = 1\n", b"# coding: nope\n", b"\xff\n", b"a\n\xed\xa0\x80\n",
        b"\xef\xbb\xbf\xef\xbb\xbfx\n", b"x\0y\nz\n", b"decoding = 1\nencoding=2\n",
        b"line\n" * 300_000,
    ]
    files = file_table(spark, [("r", f"f{at}.py", raw) for at, raw in enumerate(raws)])
    expected = []
    for at, raw in enumerate(raws):
        try:
            lines = N.read_source(raw).splitlines()
        except (SyntaxError, UnicodeDecodeError, LookupError):
            continue
        expected += [(f"f{at}.py", number, text) for number, text in enumerate(lines, start=1)]
    found = files.join(N.source_lines(files), "content_sha").select("path", "line", "text")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_utf8_lines_need_no_python(spark):
    files = file_table(spark, [("r", "a.py", b"x\ny\n"), ("r", "b.py", b"# coding: latin-1\nx\n")])
    plan = N._utf8_lines(files)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    both = N.source_lines(files)._jdf.queryExecution().executedPlan().toString()
    assert both.count("MapInArrow") == 1


def test_long_lines_keep_their_snippet(scan_cases):
    padding = "x" * 3000
    line = f"eval(a); eval(b); y = '{padding}'"
    security, _ = scan_cases({"long": f"if c:\n    {line}   \n    eval(d)"})
    assert [f.code_snippet for f in security["long"]] == [line, line, "eval(d)"]


def test_scopes_follow_the_columns(sources):
    """Inherited attributes a job does not ask for are not worked out; those it does are the same."""
    text = "def f(a):\n    if a:\n        b = g(a)\n        return b\n        c = 1\n"
    tree = ast.parse(text)
    whole = list(N.tree_rows("s", tree, text.splitlines(), N.Wanted()))
    needs = N.Needs(("Return", "Assign"), ("content_sha", "kind", "lineno", "next_line", "nest"))
    wanted = N.Wanted(kinds=frozenset(needs.kinds), lines=False, scopes=N._scopes(needs))
    part = list(N.tree_rows("s", tree, text.splitlines(), wanted))
    assert part and all(row["flow"] is None for row in part)
    same = [tuple(row.get(c) for c in needs.columns) for row in whole if row["kind"] in needs.kinds]
    assert same == [tuple(row.get(c) for c in needs.columns) for row in part]


def test_plain_sources_are_read_as_by_their_codec():
    for raw in (b"", b"x = 1\n", b"x = '\r\n'\ry", b"# coding: latin-1\nx = 1\n",
                b"#!/bin/sh\n# -*- coding: utf-8 -*-\n", "é = 1".encode(), b"\n\n# coding: none\n"):
        buffer = io.BytesIO(raw)
        encoding, _ = tokenize.detect_encoding(buffer.readline)
        buffer.seek(0)
        assert N.read_source(raw) == io.TextIOWrapper(buffer, encoding).read()


def test_views_of_fewer_columns(spark, sources):
    """Rows that need no place in the tree come from a plain visit, and say the same."""
    files = file_table(spark, [("std", name, raw) for name, raw in sources.items()])
    for view, needs, columns in (
        (views.calls, views.CALLS, ("func_kind", "func_name", "recv_kind", "recv_name", "args", "kws")),
        (views.calls, views.CALLS, ("func_name",)),
        (views.calls, views.CALLS, ("fns",)),
        (views.functions, views.FUNCTIONS, ("ident", "params")),
        (views.assigns, views.ASSIGNS, ("targets", "value")),
    ):
        less = view(N.syntax_nodes(files, needs.only(*columns)))
        assert {"content_sha", "line"} < set(less.columns) and len(less.columns) == len(columns) + 2
        whole = view(N.syntax_nodes(files, needs)).select(*less.columns)
        assert Counter(map(repr, less.collect())) == Counter(map(repr, whole.collect()))


def test_lines_are_made_where_their_text_is_asked_for(spark):
    files = file_table(spark, [("r", "a.py", b"x = f()\n")])
    kinds = [r.kind for r in N.syntax_nodes(files, views.KIND_COUNTS).collect()]
    assert sorted(kinds) == sorted(["Module", "Assign", "Name", "Call", "Name"])
    needs = N.Needs((), ("kind", "text"))
    assert N.LINE in [r.kind for r in N.syntax_nodes(files, needs).collect()]


def test_reads_are_the_only_names_of_a_quality_scan(spark):
    """Names stored, or read outside functions, give no row: no check looks at them."""
    text = "a = b\ndef f(c=d):\n    e = g\n    del h\n    return lambda: e + i\n"
    files = file_table(spark, [("r", "a.py", text)])
    rows = N.syntax_nodes(files, quality.QUALITY_NEEDS).filter("kind = 'Name'").collect()
    assert sorted(r.ident for r in rows) == ["e", "g", "i"]
    assert all(r.ctx == "Load" and r.body_fns for r in rows)
    less = N.Needs((N.READ,), ("content_sha", "kind", "ident"))
    assert sorted(r.ident for r in N.syntax_nodes(files, less).collect()) == ["e", "g", "i"]
