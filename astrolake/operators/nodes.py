"""Source bytes to syntax-tree rows: the one Python stage of a scan.

The job writes down what the tree looks like (nested-set numbers, names, the shape of direct
operands, enclosing functions and blocks), and the inherited order attributes.  Every rule, threshold and
score is DataFrame code over these rows.  Rows of one file leave the same task, so aggregations by file
or function combine before they shuffle.
"""

from __future__ import annotations

import ast
import gc
import io
import tokenize
import warnings
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple, get_args

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from astrolake.fixed_values import (
    BRANCH_KINDS,
    FUNCTION_KINDS,
    NESTING_KINDS,
    PARSE_FAILURE,
    READ_FAILURE,
    SYNTAX_FAILURE,
    TERMINAL_KINDS,
)

FUNCTION = "struct<depth:int,pre:int,name:string>"
# `run` numbers the stretches of a function with more than RUN_STATEMENTS; null in other functions.
FLOW = f"struct<fn:{FUNCTION},key:array<int>,run:int>"
# Direct operands: call and comparison arguments, keyword arguments, assigned or tested values.
ARGUMENT = (
    "struct<kind:string,ident:string,op:string,const_type:string,const_str:string,"
    "call_attr:string,sides:array<struct<kind:string,const_type:string>>,names:array<string>>"
)
KEYWORD = "struct<name:string,kind:string,ident:string,const_type:string,const_truthy:boolean>"
VALUE = (
    "struct<kind:string,const_type:string,const_str:string,const_truthy:boolean,"
    "call_attr:string,call_recv:string,names:array<string>>"
)

# One row per syntax node.  Inherited columns are filled for the kinds named beside them.
NODE_SCHEMA = f"""
    content_sha string, kind string,
    pre int, last int, depth int, parent int, field string, idx int, lineno int,
    ident string, ctx string, op string, cmp_ops array<string>,
    const_type string, const_str string, const_truthy boolean, n_list int,
    func_kind string, func_name string, recv_kind string, recv_name string, recv_root string,
    args array<{ARGUMENT}>, kws array<{KEYWORD}>,
    targets array<struct<kind:string,ident:string>>, value {VALUE}, params array<string>, runs int,
    body_line int, else_line int, next_line int,
    fns array<{FUNCTION}>, body_fns array<{FUNCTION}>, own_fn {FUNCTION},
    nest int, block_key array<int>, flow {FLOW}, events array<{FLOW}>,
    text string, parse_error string
"""

UNPARSED = "#unparsed"  # status row of a file without a tree
READ = "#read"  # asks for the names read inside a function, of all rows of kind Name
LINE = "#line"  # a source line that a call or an assignment begins on, once per content
ROWS_PER_BATCH = 10_000
RUN_STATEMENTS = 1024  # simple statements of one stretch of a long function

_FOLDED = (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCHING = tuple(getattr(ast, kind) for kind in NESTING_KINDS)
_FLOW_THROUGH = (*_BRANCHING, ast.ExceptHandler)
_BLOCKS = frozenset({"body", "orelse", "finalbody", "handlers"})
_STATEMENTS = frozenset(ast.stmt.__subclasses__())
_HOLDERS = _STATEMENTS | {ast.Lambda, ast.ExceptHandler, ast.Module, ast.match_case}
_BLOCK_RANK = {"body": 0, "orelse": 1, "finalbody": 2, "handlers": 3}


def _fields_of(cls: type) -> tuple[str, ...]:
    """Fields of a node class that can hold further nodes."""
    types = getattr(cls, "_field_types", None)
    if types is None:
        return cls._fields
    found = []
    for field, declared in types.items():
        held = [t for t in (get_args(declared) or (declared,)) if isinstance(t, type)]
        if any(issubclass(t, ast.AST) and not issubclass(t, _FOLDED) for t in held):
            found.append(field)
    return tuple(found)


# Classes that are nodes of the table, with the fields that lead on.
_CHILD_FIELDS = {
    cls: _fields_of(cls)
    for cls in vars(ast).values()
    if isinstance(cls, type) and issubclass(cls, ast.AST)
    and not issubclass(cls, _FOLDED)
    and (cls is ast.Constant or not issubclass(cls, ast.Constant))  # outdated aliases
}


# Fields to follow for every node, for statements only, or for none below the module.
_LEADS = {
    "all": _CHILD_FIELDS,
    "statements": {
        cls: tuple(f for f in fields if f in (*_BLOCKS, "cases"))
        if cls in _STATEMENTS | {ast.Module, ast.ExceptHandler, ast.match_case} else ()
        for cls, fields in _CHILD_FIELDS.items()
    },
    "module": dict.fromkeys(_CHILD_FIELDS, ()),
}


# Families of rows: a stored node table has a folder for each, and readers take only theirs.
FAMILIES = {
    "call": ("Call", "Compare"),
    "store": ("Assign", "AnnAssign", "AugAssign"),
    "definition": FUNCTION_KINDS,
    "name": ("Name", READ),
    "flow": tuple(dict.fromkeys(
        (*BRANCH_KINDS, *NESTING_KINDS, *TERMINAL_KINDS, "If", "BoolOp", "comprehension"))),
    "line": (LINE,),
    "status": ("Module", UNPARSED),
}
_FAMILY_OF = {kind: family for family, kinds in FAMILIES.items() for kind in kinds}
OTHER_FAMILY = "other"


def with_family(nodes: DataFrame) -> DataFrame:
    """`nodes` with the `family` of each row."""
    names = F.create_map(*(F.lit(x) for pair in _FAMILY_OF.items() for x in pair))
    return nodes.withColumn("family", F.coalesce(F.try_element_at(names, "kind"), F.lit(OTHER_FAMILY)))


def rows_of(nodes: DataFrame, *kinds: str) -> DataFrame:
    """`nodes` without the families that hold none of `kinds`: of a stored table their folders are
    not read.  The filter on kinds itself is left to the reader."""
    if "family" not in nodes.columns:
        return nodes
    wanted = dict.fromkeys(_FAMILY_OF.get(kind, OTHER_FAMILY) for kind in kinds)
    return nodes.filter(F.col("family").isin(*wanted))


class Uses(NamedTuple):
    """What a fixed set of rules and checks uses of the rows it needs."""

    called: frozenset[str]  # names of functions a call must have,
    passed: frozenset[str]  # or attributes it must be handed
    drawn: frozenset[str]  # methods that may give an assigned value; string literals may always
    sinks: tuple[str, ...]  # words of which one stands in the text of a file with a shell call


class Needs(NamedTuple):
    """Rows and columns of the node table an operator reads.  The parse job writes nothing else:
    neither a filter nor a projection on the output of a Python stage is pushed into it.  With `uses`,
    it also leaves out rows and cells that none of the rules and checks it names can use."""

    kinds: tuple[str, ...]
    columns: tuple[str, ...]
    uses: Uses | None = None

    def __or__(self, other: Needs) -> Needs:
        return Needs(
            tuple(dict.fromkeys(self.kinds + other.kinds)),
            tuple(dict.fromkeys(self.columns + other.columns)),
        )

    def only(self, *columns: str) -> Needs:
        """The same rows with less in them: content, kind, line and the given columns."""
        kept = ("content_sha", "kind", "lineno", *columns)
        return Needs(self.kinds, tuple(name for name in self.columns if name in kept))


STATUS = Needs(("Module", UNPARSED), ("content_sha", "kind", "parse_error"))


class Scope(NamedTuple):
    """Attributes a node inherits from the nodes above it."""

    fns: tuple = ()  # enclosing functions, decorators and defaults included
    body_fns: tuple = ()  # enclosing functions entered through their body
    own_fn: tuple | None = None  # the function this code belongs to
    nest: int | None = None  # control depth of the block a statement stands in
    block_key: tuple | None = None  # place in the reachability order
    flow: tuple | None = None  # (function, place in its execution order, run)
    events: tuple = ()  # flow places of the simple statements around a node


_scope = partial(tuple.__new__, Scope)  # of a tuple of all attributes


def read_source(raw: bytes) -> str:
    """Decode by BOM or coding declaration, UTF-8 otherwise, with universal newlines."""
    # ASCII means itself where nothing in the first two lines could name a codec.
    if raw.isascii() and b"\r" not in raw and b"coding" not in b"".join(raw.split(b"\n", 2)[:2]):
        return raw.decode("ascii")
    buffer = io.BytesIO(raw)
    encoding, _ = tokenize.detect_encoding(buffer.readline)
    buffer.seek(0)
    return io.TextIOWrapper(buffer, encoding, line_buffering=True).read()


def _utf8(text: str) -> str:
    """Lone surrogates (legal in literals) have no UTF-8 form; everything else is unchanged."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _constant(node: ast.AST) -> dict:
    if not isinstance(node, ast.Constant):
        return {}
    value = node.value
    return {
        "const_type": type(value).__name__,
        "const_str": _utf8(value) if isinstance(value, str) else None,
        "const_truthy": bool(value),
    }


def _names(node: ast.AST) -> list[str]:
    """Names in an operand, each once, in breadth-first order."""
    if type(node) is ast.Name:
        return [node.id]
    found, level = {}, [node]
    while level:
        below = []
        for parent in level:
            for field in _CHILD_FIELDS[type(parent)]:
                value = getattr(parent, field, None)
                below += value if type(value) is list else (value,)
        level = [child for child in below if type(child) in _CHILD_FIELDS]
        for child in level:
            if type(child) is ast.Name:
                found[child.id] = None
    return list(found)


_NAMED_BY = {
    ast.Name: "id", ast.Attribute: "attr", ast.arg: "arg", ast.keyword: "arg", ast.alias: "name",
    ast.FunctionDef: "name", ast.AsyncFunctionDef: "name", ast.ClassDef: "name",
}


def _ident(node: ast.AST) -> str | None:
    attribute = _NAMED_BY.get(type(node))
    return getattr(node, attribute) if attribute else None


def _argument(node: ast.AST) -> dict:
    out = {"kind": type(node).__name__, "ident": _ident(node), "names": _names(node)}
    if isinstance(node, ast.Constant):
        out.update(_constant(node))
    elif isinstance(node, ast.BinOp):
        out["op"] = type(node.op).__name__
        out["sides"] = [
            {"kind": type(side).__name__, "const_type": _constant(side).get("const_type")}
            for side in (node.left, node.right)
        ]
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        out["call_attr"] = node.func.attr
    return out


def _keyword(node: ast.keyword) -> dict:
    value = node.value
    return {
        "name": node.arg, "kind": type(value).__name__, "ident": _ident(value),
        **_constant(value),
    }


def _value(node: ast.AST) -> dict:
    out = {"kind": type(node).__name__, "names": _names(node), **_constant(node)}
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        out["call_attr"] = node.func.attr
        out["call_recv"] = getattr(node.func.value, "id", None)
    return out


def _call(node: ast.Call, args: bool = True, kws: bool = True) -> dict:
    receiver = getattr(node.func, "value", None) if isinstance(node.func, ast.Attribute) else None
    return {
        "func_kind": type(node.func).__name__,
        "func_name": _ident(node.func),
        "recv_kind": type(receiver).__name__ if receiver else None,
        "recv_name": _ident(receiver) if receiver else None,
        "recv_root": getattr(getattr(receiver, "value", None), "id", None),
        "args": [_argument(arg) for arg in node.args] if args else None,
        "kws": [_keyword(kw) for kw in node.keywords] if kws else None,
    }


def _assignment(node: ast.AST) -> dict:
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    return {
        "targets": [{"kind": type(t).__name__, "ident": getattr(t, "id", None)} for t in targets],
        "value": _value(node.value) if node.value else None,
    }


def _definition(node: ast.AST) -> dict:
    spec = node.args
    named = (*spec.posonlyargs, *spec.args, *spec.kwonlyargs)
    return {"ident": node.name, "params": [a.arg for a in named]}


def _condition(node: ast.If) -> dict:
    return {
        "value": _value(node.test),
        "body_line": node.body[0].lineno,
        "else_line": node.orelse[0].lineno if node.orelse else None,
    }


def _comparison(node: ast.Compare) -> dict:
    return {
        "cmp_ops": [type(op).__name__ for op in node.ops],
        "args": [_argument(x) for x in (node.left, *node.comparators)],
    }


# Columns that describe a node itself and its direct operands.
_SHAPES = {
    ast.Name: lambda n: {"ident": n.id, "ctx": type(n.ctx).__name__},
    ast.Attribute: lambda n: {"ident": n.attr, "ctx": type(n.ctx).__name__},
    ast.Constant: _constant,
    ast.Call: _call,
    ast.Assign: _assignment,
    ast.AnnAssign: _assignment,
    ast.AugAssign: _assignment,
    ast.Compare: _comparison,
    ast.If: _condition,
    ast.FunctionDef: _definition,
    ast.AsyncFunctionDef: _definition,
    ast.BinOp: lambda n: {"op": type(n.op).__name__},
    ast.BoolOp: lambda n: {"op": type(n.op).__name__, "n_list": len(n.values)},
    ast.comprehension: lambda n: {"n_list": len(n.ifs)},
}


_LINKS = frozenset({"last", "parent", "field", "idx"})
_NUMBERED = _LINKS | {"pre", "own_fn", "fns", "body_fns", "flow", "events", "runs"}
_UNSHAPED = _LINKS | frozenset({
    "content_sha", "kind", "pre", "depth", "lineno", "own_fn", "fns", "body_fns", "events",
    "nest", "block_key", "flow", "runs", "next_line", "text", "parse_error",
})


class Wanted(NamedTuple):
    """What the running job has to produce."""

    kinds: frozenset | None = None
    shaped: bool = True  # columns that describe a node itself
    linked: bool = True  # columns that place a node in its tree
    placed: bool = True  # number, depth, line and function of a node
    scopes: frozenset = frozenset(Scope._fields)  # inherited attributes to work out
    lines: bool = True  # source lines of calls and assignments
    runs: bool = True  # runs of long functions
    reach: str = "all"  # nodes to visit, see _LEADS
    numbered: bool = True  # number, depth and function of a node
    args: bool = True  # arguments and keywords of calls
    kws: bool = True
    uses: Uses | None = None  # leave out what these rules and checks cannot use


def _shape(node: ast.AST, wanted: Wanted) -> dict:
    if type(node) is ast.Call:
        return _call(node, wanted.args, wanted.kws)
    describe = _SHAPES.get(type(node))
    return describe(node) if describe else {"ident": _ident(node)}


def _nest_below(node: ast.AST, field: str, nest: int | None) -> int | None:
    if isinstance(node, ast.ClassDef):
        return None
    if isinstance(node, _DEFS):
        return 0
    if isinstance(node, ast.ExceptHandler):
        return nest
    if nest is None or not isinstance(node, _BRANCHING):
        return None
    if isinstance(node, ast.If) and field == "orelse":
        only = node.orelse[0] if len(node.orelse) == 1 else None
        return nest if isinstance(only, ast.If) else nest + 1
    return nest + 1


def _place_below(node: ast.AST, field: str, idx: int, place: tuple) -> tuple | None:
    """Order key of a block member: body, orelse, finalbody, then the handlers."""
    if isinstance(node, (ast.mod, ast.ExceptHandler)):
        return (*place, idx) if field == "body" else None
    if field == "handlers":
        return (*place, 3 + idx) if isinstance(node, ast.Try) else None
    return (*place, _BLOCK_RANK[field], idx) if field in _BLOCK_RANK else None


def _block_scope(node: ast.AST, plain: Scope, scope: Scope, me: tuple | None, field: str, idx: int,
                 flows: bool, nests: bool):
    """Scope of member `idx` of a statement block of `node`; `plain` is that of its expressions."""
    own_fn, body_fns, place, flow = plain.own_fn, plain.body_fns, None, None
    if scope.block_key is not None:
        place = _place_below(node, field, idx, scope.block_key)
    if me is not None:
        if field == "body":
            own_fn, body_fns = me, (*scope.body_fns, me)
            flow = (me, (idx,), None) if flows else None
    elif scope.flow is not None and type(node) in _FLOW_THROUGH:
        key = _place_below(node, field, idx, scope.flow[1])
        flow = (scope.flow[0], key, None) if key else None
    nest = _nest_below(node, field, scope.nest) if nests else None
    return _scope((plain.fns, body_fns, own_fn, nest, place, flow, plain.events))


def walk_tree(tree: ast.Module, leads: dict = _CHILD_FIELDS,
              wanted: frozenset = frozenset(Scope._fields)) -> list[tuple]:
    """(node, parent, field, idx, depth, scope, function, next line) in pre-order, no recursion.  Of
    the scope only the `wanted` attributes are certain to be there."""
    out: list[tuple] = []
    flows, nests = not wanted.isdisjoint(("flow", "events")), "nest" in wanted
    start = Scope(block_key=() if "block_key" in wanted else None)
    stack = [(tree, None, None, None, 0, start, None, None)]
    pop, push, note, known = stack.pop, stack.append, out.append, _CHILD_FIELDS
    pre = -1
    while stack:
        entry = pop()
        node, _, _, _, depth, scope, me, _ = entry
        cls, pre = type(node), pre + 1
        if cls in _DEFS:
            me = (depth, pre, node.name)
            entry = (*entry[:6], me, entry[7])
        note(entry)
        fields = leads[cls]
        if not fields:
            continue
        below, plain, holder = depth + 1, scope, cls in _HOLDERS and bool(wanted)
        if holder:
            # A flow place belongs to a simple statement, or only leads on through a compound one.
            simple = scope.flow and cls not in _FLOW_THROUGH
            plain = _scope((
                (*scope.fns, me) if me else scope.fns,
                scope.body_fns,
                None if me or cls is ast.Lambda else scope.own_fn,
                None, None, None,
                (*scope.events, scope.flow) if simple else scope.events,
            ))
        # The last child goes onto the stack first.
        for name in reversed(fields):
            value = getattr(node, name, None)
            if type(value) is not list:
                if type(value) in known:
                    push((value, pre, name, None, below, plain, None, None))
            elif holder and name in _BLOCKS:
                for at in range(len(value) - 1, -1, -1):
                    child = value[at]
                    if type(child) in known:
                        follower = value[at + 1] if at + 1 < len(value) else None
                        push((child, pre, name, at, below,
                              _block_scope(node, plain, scope, me, name, at, flows, nests),
                              None, getattr(follower, "lineno", None)))
            else:
                for at in range(len(value) - 1, -1, -1):
                    if type(value[at]) in known:
                        push((value[at], pre, name, at, below, plain, None, None))
    return out


def _last_descendants(walked: list[tuple]) -> list[int]:
    last = list(range(len(walked)))
    for pre in range(len(walked) - 1, 0, -1):
        parent = walked[pre][1]
        last[parent] = max(last[parent], last[pre])
    return last


def _runs_of(walked: list[tuple]) -> dict[tuple, dict[tuple, int]]:
    """Run of each simple statement, by place, of every function with more than RUN_STATEMENTS."""
    if len(walked) <= RUN_STATEMENTS:
        return {}
    keys: dict[tuple, list[tuple]] = {}
    for node, _, _, _, _, scope, _, _ in walked:
        if scope.flow and type(node) in _STATEMENTS and type(node) not in _FLOW_THROUGH:
            keys.setdefault(scope.flow[0], []).append(scope.flow[1])
    return {
        fn: {key: rank // RUN_STATEMENTS for rank, key in enumerate(sorted(places))}
        for fn, places in keys.items() if len(places) > RUN_STATEMENTS
    }


def _in_run(flow: tuple | None, runs: dict) -> tuple | None:
    return (*flow[:2], runs[flow[0]].get(flow[1])) if flow and flow[0] in runs else flow


_LEADS_BACK = {
    reach: {cls: fields[::-1] for cls, fields in leads.items()} for reach, leads in _LEADS.items()
}


def _bare_rows(sha: str, tree: ast.Module, lines: list[str], wanted: Wanted) -> Iterator[dict]:
    """`tree_rows` where nothing depends on where in the tree a node stands: one look at each node."""
    kinds, leads, known = wanted.kinds, _LEADS_BACK[wanted.reach], _CHILD_FIELDS
    stack, noted = [tree], set()
    pop, push = stack.pop, stack.append
    while stack:
        node = pop()
        cls = type(node)
        for name in leads[cls]:
            value = getattr(node, name, None)
            if type(value) is list:
                for child in reversed(value):
                    if type(child) in known:
                        push(child)
            elif type(value) in known:
                push(value)
        kind = cls.__name__
        if kinds is not None and kind not in kinds:
            continue
        row = {"content_sha": sha, "kind": kind}
        if wanted.placed:
            row["lineno"] = getattr(node, "lineno", None)
        if wanted.shaped:
            row.update(_shape(node, wanted))
        if wanted.lines and (cls is ast.Call or cls is ast.Assign):
            yield from _line_row(sha, node.lineno, lines, noted)
        yield row


def _line_row(sha: str, line: int, lines: list[str], noted: set[int]) -> Iterator[dict]:
    if line not in noted and 0 < line <= len(lines):
        noted.add(line)
        yield {"content_sha": sha, "kind": LINE, "lineno": line,
               "text": _utf8(lines[line - 1].strip())}


def tree_rows(sha: str, tree: ast.Module, lines: list[str], wanted: Wanted) -> Iterator[dict]:
    kinds = wanted.kinds
    reads = kinds is not None and READ in kinds
    walked = walk_tree(tree, _LEADS[wanted.reach], wanted.scopes)
    last = _last_descendants(walked) if wanted.linked else ()
    runs = _runs_of(walked) if wanted.runs else {}
    noted = set()
    for pre, (node, parent, field, idx, depth, scope, me, next_line) in enumerate(walked):
        cls = type(node)
        kind = cls.__name__
        if kinds is not None and kind not in kinds and not (
                reads and cls is ast.Name and scope.body_fns and type(node.ctx) is ast.Load):
            continue
        row = {"content_sha": sha, "kind": kind}
        if wanted.placed:
            row.update(pre=pre, depth=depth, lineno=getattr(node, "lineno", None),
                       own_fn=scope.own_fn)
        if wanted.linked:
            row.update(last=last[pre], parent=parent, field=field, idx=idx)
        if wanted.shaped:
            row.update(_shape(node, wanted))
        if cls is ast.Name:
            row["body_fns"] = scope.body_fns
        elif cls is ast.Call:
            row["fns"], row["events"] = scope.fns, scope.events
        elif cls is ast.Compare:
            row["fns"] = scope.fns
        elif cls in _STATEMENTS:
            row.update(nest=scope.nest, block_key=scope.block_key, flow=scope.flow,
                       next_line=next_line)
        if runs:
            if me in runs:
                row["runs"] = max(runs[me].values()) + 1
            if "flow" in row:
                row["flow"] = _in_run(row["flow"], runs)
            if "events" in row:
                row["events"] = tuple(_in_run(flow, runs) for flow in row["events"])
        if wanted.lines and (cls is ast.Call or cls is ast.Assign):
            yield from _line_row(sha, node.lineno, lines, noted)
        yield row


_STORES = (ast.Assign, ast.AnnAssign, ast.AugAssign)
_ENDS = tuple(getattr(ast, kind) for kind in TERMINAL_KINDS)
_MEMBERSHIP = (ast.In, ast.NotIn)


def _simple_store(node: ast.AST) -> str | None:
    """The one name an assignment with a value stores, unless it begins with an underscore."""
    if type(node) is ast.Assign:
        target = node.targets[0] if len(node.targets) == 1 else None
    else:
        target = node.target if type(node) is ast.AnnAssign and node.value else None
    name = target.id if type(target) is ast.Name else None
    return None if name is None or name.startswith("_") else name


def _may_be_drawn(node: ast.AST, uses: Uses) -> bool:
    """Whether the value of an assignment is a string literal or comes from a method in `drawn`."""
    value = node.value
    if type(value) is ast.Constant:
        return isinstance(value.value, str)
    return type(value) is ast.Call and type(value.func) is ast.Attribute \
        and value.func.attr in uses.drawn


def _is_used_call(node: ast.Call, uses: Uses) -> bool:
    if _ident(node.func) in uses.called:
        return True
    handed = (*node.args, *(keyword.value for keyword in node.keywords))
    return any(type(x) is ast.Attribute and x.attr in uses.passed for x in handed)


def _used_rows(sha: str, tree: ast.Module, source: str, wanted: Wanted) -> Iterator[dict]:
    """The rows of `tree_rows` without those, and without the cells, that no rule or check in
    `wanted.uses` can use: calls of other functions, comparisons that test no membership, reads of
    names the function does not store, branches outside functions, terminal statements nothing
    follows, lines no finding can stand on.  A file without a shell call has no places in an execution
    order, and its functions have no parameters: no taint can end there."""
    uses, scopes = wanted.uses, wanted.scopes
    traced = not source.isascii() or any(word in source for word in uses.sinks)
    if not traced:
        scopes = scopes - {"flow", "events"}
    walked = walk_tree(tree, _LEADS[wanted.reach], scopes)
    runs = _runs_of(walked) if traced and wanted.runs else {}
    lines = source.splitlines() if wanted.lines else []
    stored = {(scope.own_fn, _simple_store(node)) for node, _, _, _, _, scope, _, _ in walked
              if type(node) in _STORES and scope.own_fn}
    noted, read = set(), set()
    for pre, (node, _, _, _, depth, scope, me, next_line) in enumerate(walked):
        cls = type(node)
        kind = cls.__name__
        own_fn = scope.own_fn
        if cls is ast.Name:
            fns = scope.body_fns
            if fns and type(node.ctx) is ast.Load and (node.id, fns) not in read \
                    and any((fn, node.id) in stored for fn in fns):
                read.add((node.id, fns))
                yield {"content_sha": sha, "kind": kind, "ident": node.id, "ctx": "Load",
                       "body_fns": fns}
            continue
        if kind not in wanted.kinds:
            continue
        row = {"content_sha": sha, "kind": kind}
        if cls is ast.Call:
            if not _is_used_call(node, uses):
                continue
            row.update(_call(node, wanted.args, wanted.kws), pre=pre, depth=depth,
                       lineno=node.lineno, fns=scope.fns)
            if scope.events:
                row["events"] = tuple(_in_run(flow, runs) for flow in scope.events)
            yield from _line_row(sha, node.lineno, lines, noted)
        elif cls is ast.Compare:
            if not scope.fns or not any(type(op) in _MEMBERSHIP for op in node.ops):
                continue
            row.update(_comparison(node), pre=pre, depth=depth, lineno=node.lineno, fns=scope.fns)
        elif cls in _STORES:
            drawn = cls is ast.Assign and _may_be_drawn(node, uses)
            if not drawn and scope.flow is None and (
                    own_fn is None or _simple_store(node) is None):
                continue
            row.update(_assignment(node), pre=pre, depth=depth, lineno=node.lineno, own_fn=own_fn,
                       flow=_in_run(scope.flow, runs))
            if drawn:
                yield from _line_row(sha, node.lineno, lines, noted)
        elif cls in _DEFS:
            row.update(pre=pre, depth=depth, lineno=node.lineno, ident=node.name)
            if traced:
                row.update(_definition(node))
            if me in runs:
                row["runs"] = max(runs[me].values()) + 1
        elif cls in _ENDS:
            if next_line is None or scope.block_key is None:
                continue
            row.update(lineno=node.lineno, next_line=next_line, block_key=scope.block_key)
        elif cls is not ast.Module:
            constant = cls is ast.If and type(node.test) is ast.Constant
            if constant and scope.block_key is not None:
                row.update(_condition(node), block_key=scope.block_key)
            elif own_fn is None:
                continue
            if cls is ast.BoolOp:
                row["n_list"] = len(node.values)
            elif cls is ast.comprehension:
                row["n_list"] = len(node.ifs)
            row.update(own_fn=own_fn, nest=scope.nest)
        yield row


def file_rows(sha: str, raw: bytes, wanted: Wanted) -> Iterator[dict]:
    """All rows of one file.  A file that cannot be read or parsed gives one status row."""
    failure = None
    try:
        source = read_source(raw)
    except (OSError, SyntaxError, UnicodeDecodeError, LookupError) as exc:
        failure = READ_FAILURE.format(error=exc)
    else:
        try:
            tree = ast.parse(source)
        except SyntaxError as exc:
            failure = SYNTAX_FAILURE.format(line=exc.lineno, error=exc.msg)
        except (ValueError, RecursionError, MemoryError) as exc:
            failure = PARSE_FAILURE.format(error=exc or type(exc).__name__)
    if failure is None:
        if wanted.uses is not None:
            yield from _used_rows(sha, tree, source, wanted)
            return
        bare = not (wanted.scopes or wanted.linked or wanted.runs or wanted.numbered)
        rows = _bare_rows if bare else tree_rows
        yield from rows(sha, tree, source.splitlines() if wanted.lines else [], wanted)
    elif wanted.kinds is None or UNPARSED in wanted.kinds:
        yield {"content_sha": sha, "kind": UNPARSED, "parse_error": _utf8(failure)}


def _column(at: list[int], values: list, rows: int, kind: pa.DataType) -> pa.Array:
    """Column with `values` in the rows `at`, null elsewhere."""
    found = pa.array(values, type=kind)
    if len(at) == rows:
        return found
    index = np.full(rows, -1, dtype=np.int32)
    index[at] = np.arange(len(at), dtype=np.int32)
    return found.take(pa.array(index, mask=index < 0))


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of sparse rows: the cost follows the values present, not the columns."""
    cells = {name: ([], []) for name in schema.names}
    find = {name: (at.append, values.append) for name, (at, values) in cells.items()}.get
    count = 0

    def flush():
        columns = [_column(*cells[f.name], count, f.type) for f in schema]
        for at, values in cells.values():
            at.clear()
            values.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        for name, value in row.items():
            if value is not None and (put := find(name)) is not None:
                put[0](count)
                put[1](value)
        count += 1
        if count >= ROWS_PER_BATCH:
            yield flush()
            count = 0
    if count:
        yield flush()


def _files_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Each content once: rows that repeat one file come to the same task."""
    seen = set()
    for batch in batches:
        contents = batch.column("content")
        for at, name in enumerate(batch.column("content_sha").to_pylist()):
            if name not in seen:
                seen.add(name)
                yield name, contents[at].as_py()


def _numbered_rows(batches: Iterable[pa.RecordBatch], wanted: Wanted) -> Iterator[dict]:
    """Rows of each content once, under its number; the status row has its hash."""
    seen = set()
    for batch in batches:
        contents, names = batch.column("content"), batch.column("content_sha").to_pylist()
        for at, number in enumerate(batch.column("number").to_pylist()):
            if (name := names[at]) in seen:
                continue
            seen.add(name)
            for row in file_rows(number, contents[at].as_py(), wanted):
                if row["kind"] in STATUS.kinds:
                    row["hash"] = name
                yield row


def content_owners(listing: DataFrame) -> DataFrame:
    """(content_sha, _owner): the least hash of the names of the files that hold a content."""
    return listing.groupBy("content_sha").agg(F.min(F.xxhash64("repo_id", "path")).alias("_owner"))


def distinct_contents(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(content_sha, content), one file of each content; with a `listing` of the files without their
    texts, or its `content_owners`, only of the contents listed there.

    Only hashes are aggregated: the file with the least hash of its name owns a content.  The text
    moves once, unsorted, in a hash join on (content, name): copies have other names, so a content
    that many files share is spread over the tasks, where all but its owner's row fall out.
    """
    listing = files if listing is None else listing
    owners = listing if "_owner" in listing.columns else content_owners(listing)
    named = files.select("content_sha", "content", F.xxhash64("repo_id", "path").alias("_owner"))
    return named.join(owners.hint("shuffle_hash"), ["content_sha", "_owner"]).select(
        "content_sha", "content")


def _reach(needs: Needs) -> str:
    """How much of a tree must be visited.  Node numbers count all nodes, so asking for one of them
    means visiting all."""
    kinds = set(needs.kinds) - {UNPARSED, LINE}
    if not kinds or not _NUMBERED.isdisjoint(needs.columns):
        return "all"
    if kinds == {"Module"}:
        return "module"
    return "statements" if kinds <= {cls.__name__ for cls in _STATEMENTS} else "all"


def _scopes(needs: Needs) -> frozenset:
    """Inherited attributes behind the columns: next siblings are noted with the blocks, runs follow
    from the flow."""
    behind = {"next_line": "block_key", "runs": "flow"}
    named = frozenset(behind.get(name, name) for name in needs.columns).intersection(Scope._fields)
    return named | {"body_fns"} if READ in needs.kinds else named


def syntax_nodes(files: DataFrame, needs: Needs | None = None,
                 listing: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """Node table of `files`, or the part of it that `needs` names.  See `distinct_contents` for the
    `listing`; it must hold all files of a content or none.

    If `numbered`, `content_sha` is a number of the content, drawn anew by each run of the job: to be
    used only where the rows are written.  Status rows tell the `hash` that stands for it.
    """
    schema, wanted = StructType.fromDDL(NODE_SCHEMA), Wanted()
    if needs is not None:
        schema = StructType([f for f in schema if f.name in needs.columns])
        wanted = Wanted(
            kinds=frozenset(needs.kinds) or None,
            shaped=not _UNSHAPED.issuperset(needs.columns),
            linked=not _LINKS.isdisjoint(needs.columns),
            placed=not {"content_sha", "kind"}.issuperset(needs.columns),
            scopes=_scopes(needs),
            lines="text" in needs.columns if not needs.kinds else LINE in needs.kinds,
            runs="runs" in needs.columns,
            reach=_reach(needs),
            numbered=not {"pre", "depth"}.isdisjoint(needs.columns),
            args="args" in needs.columns,
            kws="kws" in needs.columns,
            uses=needs.uses,
        )
    contents = distinct_contents(files, listing)
    if numbered:
        key = contents.schema["content_sha"].dataType
        contents = contents.withColumn("number", F.monotonically_increasing_id())
        schema = StructType([StructField(f.name, LongType()) if f.name == "content_sha" else f
                             for f in schema]).add("hash", key)
    arrow_schema = to_arrow_schema(schema)

    def parse(batches):
        # Trees hold no cycles: looking for some after every two thousand nodes finds nothing.
        before = gc.get_threshold()
        gc.set_threshold(200_000, *before[1:])
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                rows = _numbered_rows(batches, wanted) if numbered else (
                    row for sha, raw in _files_in(batches) for row in file_rows(sha, raw, wanted))
                yield from _batches(rows, arrow_schema)
        finally:
            gc.set_threshold(*before)

    return contents.mapInArrow(parse, schema)


# What ends a line of source text; \r\n is one end.
_LINE_END = "(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"
LINE_SCHEMA = "content_sha string, line int, text string"


def _plain_utf8() -> Column:
    """Whether a content is read as UTF-8 for certain: nothing in its first two lines could declare a
    codec, and it has no zero byte."""
    text = F.col("content").cast("string")
    return ~F.substring_index(text, "\n", 2).rlike("coding[:=]") & ~F.contains(text, F.lit("\0"))


def _utf8_lines(files: DataFrame) -> DataFrame:
    """Lines of contents without codec line, by Spark alone; wrong UTF-8 has none."""
    text = F.col("content").cast("string")
    bom = F.lit("\ufeff")
    decoded = distinct_contents(files).where(F.is_valid_utf8(text)).select(
        "content_sha",
        F.when(F.startswith(text, bom), F.substring(text, 2, 2**31 - 1)).otherwise(text)
        .alias("_text"),
    )
    # The end of the last line begins no other; an empty file has no line.
    return decoded.where("_text <> ''").select(
        "content_sha",
        F.posexplode(F.split(F.regexp_replace("_text", _LINE_END + "\\z", ""), _LINE_END))
        .alias("_at", "text"),
    ).select("content_sha", (F.col("_at") + 1).alias("line"), "text")


def _codec_lines(files: DataFrame) -> DataFrame:
    """Lines of any contents, decoded as Python reads them."""
    schema = pa.schema([("content_sha", pa.string()), ("line", pa.int32()), ("text", pa.string())])

    def split(batches):
        def rows():
            for sha, raw in _files_in(batches):
                try:
                    source = read_source(raw)
                except (OSError, SyntaxError, UnicodeDecodeError, LookupError):
                    continue
                for number, text in enumerate(source.splitlines(), start=1):
                    yield {"content_sha": sha, "line": number, "text": _utf8(text)}

        yield from _batches(rows(), schema)

    return distinct_contents(files).mapInArrow(split, LINE_SCHEMA)


def source_lines(files: DataFrame) -> DataFrame:
    """(content_sha, line, text) for every line of every readable file.

    Contents read as UTF-8, with or without a byte-order mark, are decoded and split in the JVM; only
    those whose first lines may name a codec go through Python.  A null content has no lines.
    """
    plain = F.coalesce(_plain_utf8(), F.lit(True))
    files = files.where("content IS NOT NULL")
    return _utf8_lines(files.where(plain)).unionByName(_codec_lines(files.where(~plain)))


def parse_status(nodes: DataFrame, key: str = "content_sha") -> DataFrame:
    """One row per distinct content: (content_sha, ok, parse_error)."""
    return rows_of(nodes, "Module", UNPARSED).filter(F.col("kind").isin("Module", UNPARSED)).select(
        F.col(key).alias("content_sha"), (F.col("kind") == "Module").alias("ok"), "parse_error"
    )
