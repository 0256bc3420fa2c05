"""Taint trace: order, kill, branches, nested scopes."""

import random
import time

import pytest

from astrolake.operators import nodes, taint
from astrolake.operators.scan import Scan
from conftest import file_table

CASES = {
    # name: ([(function, variable, line)], source)
    "parameter": ([("f", "cmd", 2)], "def f(cmd):\n    os.system(cmd)"),
    "plus": ([("f", "cmd", 2)], "def f(cmd):\n    os.popen('ls ' + cmd)"),
    "fstring": ([("f", "cmd", 2)], "def f(cmd):\n    os.system(f'ls {cmd}')"),
    "three_steps": ([("f", "c", 5)],
                    "def f(a):\n    b = a\n    c = b\n    c = c + 'x'\n    os.system(c)"),
    "subprocess": ([("f", "x", 2)], "def f(x):\n    subprocess.run(x, shell=True)"),
    "keyword_only": ([("f", "x", 2)], "def f(*, x):\n    os.system(x)"),
    "positional_only": ([("f", "x", 2)], "def f(x, /):\n    os.system(x)"),
    "async": ([("f", "x", 2)], "async def f(x):\n    os.system(x)"),
    "self": ([("m", "self", 3)], "class C:\n  def m(self):\n    os.system(self.cmd)"),
    "star_args": ([], "def f(*a, **k):\n    os.system(a); os.system(k)"),
    "killed": ([], "def f(cmd):\n    cmd = 'ls'\n    os.system(cmd)"),
    "killed_later": ([("f", "cmd", 2)], "def f(cmd):\n    os.system(cmd)\n    cmd = 'ls'"),
    "other_variable": ([], "def f(cmd):\n    x = 'ls'\n    os.system(x)"),
    "no_sink": ([], "def f(cmd):\n    print(cmd)"),
    "no_shell": ([], "def f(cmd):\n    subprocess.run(cmd)"),
    "keyword_argument": ([], "def f(cmd):\n    os.system(command=cmd)"),
    "augmented": ([("f", "x", 4)], "def f(a):\n    x = 'ls'\n    x += a\n    os.system(x)"),
    "augmented_keeps": ([("f", "a", 3)], "def f(a):\n    a += 'x'\n    os.system(a)"),
    "tuple_target": ([("f", "a", 3)], "def f(a):\n    a, b = 1, 2\n    os.system(a)"),
    "annotated_target": ([("f", "a", 3)], "def f(a):\n    a: str = 'x'\n    os.system(a)"),
    "chained_targets": ([("f", "y", 3)], "def f(a):\n    x = y = a\n    os.system(y)"),
    "first_tainted_name": ([("f", "b", 3)],
                           "def f(a, b):\n    a = 1\n    os.system(a + b, c)"),
    "breadth_first_name": ([("f", "b", 2)], "def f(a, b):\n    os.system((1 + a) + b)"),
    "branch_shared": ([("f", "x", 5)],
                      "def f(a):\n    x = 'ls'\n    if c:\n        x = a\n    os.system(x)"),
    "branch_kills": ([], "def f(a):\n    if c:\n        a = 'ls'\n    os.system(a)"),
    "else_after_body": ([], "def f(a):\n  if c:\n    a = 1\n  else:\n    os.system(a)"),
    "handlers_last": ([("f", "x", 7)],
                      "def f(a):\n  x = 1\n  try:\n    pass\n  except E:\n    pass\n"
                      "    os.system(x)\n  finally:\n    x = a"),
    "header_unchecked": ([], "def f(a):\n    if os.system(a):\n        pass\n"
                             "    while os.system(a):\n        pass"),
    "with_header": ([], "def f(a):\n    with os.popen(a) as p:\n        pass"),
    "loop_body": ([("f", "a", 3)], "def f(a):\n    for i in x:\n        os.system(a)"),
    "nested_twice": ([("outer", "a", 3), ("inner", "b", 3)],
                     "def outer(a):\n    def inner(b):\n        os.system(a + b)"),
    "nested_own_only": ([("inner", "b", 3)],
                        "def outer(a):\n    def inner(b):\n        os.system(b)"),
    "match_is_simple": ([("f", "a", 4)],
                        "def f(a):\n    match x:\n        case 1:\n            os.system(a)"),
    "except_star_is_simple": ([("f", "a", 4)],
                              "def f(a):\n  try:\n    a = 1\n    os.system(a)\n"
                              "  except* E:\n    pass"),
    "lambda_in_statement": ([("f", "a", 2)], "def f(a):\n    g = lambda: os.system(a)"),
    "assign_then_sink": ([("f", "x", 2)], "def f(a):\n    x = a + str(os.system(x))"),
    "two_calls": ([("f", "a", 2), ("f", "a", 2)],
                  "def f(a):\n    g(os.system(a), os.popen(a))"),
    "class_body": ([("f", "a", 3)], "def f(a):\n    class C:\n        x = os.system(a)"),
    "default_value": ([], "def f(a, b=os.system(x)):\n    pass"),
    "module_level": ([], "cmd = input()\nos.system(cmd)"),
}


@pytest.fixture(scope="module")
def traced(scan_cases):
    security, _ = scan_cases({name: source for name, (_, source) in CASES.items()})
    return {
        name: [f for f in rows if f.rule_id == "command_injection_taint"]
        for name, rows in security.items()
    }


@pytest.mark.parametrize("name", CASES)
def test_trace(traced, name):
    expected, _ = CASES[name]
    found = [
        (f.function_name, f.message.split("via variable '")[1].split("'")[0], f.line)
        for f in traced[name]
    ]
    assert found == expected
    assert {(f.severity, f.confidence) for f in traced[name]} <= {("critical", "high")}


def test_long_function_takes_linear_time(spark):
    lines = "\n".join(f"    v{i} = v{i - 1}" for i in range(1, 50_000))
    text = f"import os\ndef f(v0):\n{lines}\n    os.system(v49999)\n"
    files = file_table(spark, [("r", "a.py", text)])
    start = time.perf_counter()
    (hit,) = Scan(files).rule("command_injection_taint").collect()
    assert hit.line == 50_002 and "'v49999'" in hit.message
    assert time.perf_counter() - start < 60


def random_function(seed, statements):
    """A function of random assignments and sinks over few names, some inside nested blocks."""
    draw = random.Random(seed)
    names = [f"v{i}" for i in range(12)]
    pick = lambda: draw.choice(names)
    lines = ["import os", "def f(v0, v1):"]
    depth = 1
    for _ in range(statements):
        move = draw.random()
        if move < 0.1 and depth < 4:
            lines.append("    " * depth + f"{draw.choice(['if c:', 'for i in c:', 'try:'])}")
            opened = lines[-1].strip()
            lines.append("    " * (depth + 1) + f"{pick()} = {pick()}")
            if opened == "try:":
                lines.append("    " * depth + f"except E:\n{'    ' * (depth + 1)}os.system({pick()})")
                lines.append("    " * depth + f"finally:\n{'    ' * (depth + 1)}{pick()} = {pick()}")
            else:
                depth += 1
        elif move < 0.2 and depth > 1:
            depth -= 1
        elif move < 0.35:
            lines.append("    " * depth + f"os.system({pick()} + {pick()}, {pick()})")
        elif move < 0.5:
            lines.append("    " * depth + f"{pick()} += {pick()}")
        elif move < 0.7:
            lines.append("    " * depth + f"{pick()} = 'ls'")
        else:
            lines.append("    " * depth + f"{pick()} = {pick()} = {pick()} + {pick()}")
    return "\n".join(lines)


def test_runs_equal_the_fold(spark, monkeypatch):
    """A function cut into runs has the hits of one fold over all of it, over several levels."""
    files = file_table(spark, [
        ("r", f"{seed}.py", random_function(seed, size))
        for seed, size in enumerate((1100, 1500, 2500, 4000, 6000, 30))])
    tree = nodes.syntax_nodes(files, taint.TAINT_NEEDS).cache()
    events, cut = {}, set()
    for row in taint.taint_events(tree).collect():
        events.setdefault(row.content_sha, []).append(row)
        cut.add(row.run)
    whole = [
        (sha, line, name, pos)
        for sha, rows in events.items()
        for line, name, pos in taint.traced(sorted(
            rows, key=lambda e: (e["key"], e["step"], e["order"] or [])))
    ]
    assert max(run for run in cut if run is not None) >= 4 and None in cut
    monkeypatch.setattr(taint, "FAN_IN", 2)
    for read in (tree, nodes.with_family(tree)):  # from the parse job, and as stored
        in_runs = [
            (row.content_sha, row.line, row["var"], row.pos[2:])
            for row in taint.taint_findings(read).collect()
        ]
        assert len(in_runs) > 100
        assert sorted(in_runs) == sorted(whole)


def test_summaries_merge_associatively():
    """Any bracketing of merged runs has the states of the runs one after the other."""
    draw = random.Random(5)
    names = "abcdefg"
    for _ in range(300):
        parts, events = [], []
        for _ in range(3):
            run = [{"step": draw.choice((taint.SEED, taint.ASSIGN, taint.AUGMENT)),
                    "names": draw.sample(names, draw.randint(0, 2)),
                    "targets": draw.sample(names, draw.randint(0, 2))}
                   for _ in range(draw.randint(0, 6))]
            parts.append(taint.summarised(run)[0])
            events += run
        a, b, c = parts
        left, right = a.then(b).then(c), a.then(b.then(c))
        assert left.sets == right.sets and left.reads == right.reads
        for start in (set(), {"a"}, set("bdf")):
            merged, steps = set(start), set(start)
            left.leave(merged)
            for part in parts:
                part.leave(steps)
            assert merged == steps
            plain = set(start)
            for e in events:
                if e["step"] == taint.SEED or not plain.isdisjoint(e["names"]):
                    plain.update(e["targets"])
                elif e["step"] == taint.ASSIGN:
                    plain.difference_update(e["targets"])
            assert merged == plain


def test_events_of_a_long_function_are_spread(spark):
    """No group holds more statements than a run, though the function is one."""
    lines = "\n".join(f"    v{i % 7} = v{i % 5}" for i in range(20_000))
    text = f"import os\ndef f(v0):\n{lines}\n    os.system(v0)\n"
    rows = nodes.syntax_nodes(file_table(spark, [("r", "a.py", text)]), taint.TAINT_NEEDS)
    sizes = taint.taint_events(rows).groupBy("fn", "run").count().collect()
    assert len(sizes) == 20
    assert max(row["count"] for row in sizes) <= nodes.RUN_STATEMENTS + 1  # and the parameters
