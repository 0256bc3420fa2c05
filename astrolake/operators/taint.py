"""Taint trace: does a function parameter reach a shell call through assignments?

The events of a function are grouped once; functions without a sink are dropped before the fold.
The fold keeps a set of names and takes constant time for each event.  Array functions would copy
the set at every step, which is quadratic for a long function, so this small loop is in Python.

A group is one function of one file, or one run of a long function: the parse job numbers the runs
of functions with more than `RUN_STATEMENTS` simple statements.  A run is summarised without knowing
what is tainted before it (`Summary`).  Summaries merge by an associative operator, FAN_IN at a time
and level by level; going down again each run learns which names are tainted on entry, and its sinks
are settled by a join.  So the events of one function are spread over tasks.  All sinks of a single
statement stay in one run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from astrolake.fixed_values import FUNCTION_KINDS, OS_SHELL_FUNCTIONS, SUBPROCESS_FUNCTIONS
from astrolake.functions import predicates as P
from astrolake.functions.predicates import of_kind
from astrolake.operators.nodes import FLOW, FUNCTION, Needs, rows_of
from astrolake.session import settled, spread

TAINT_NEEDS = Needs(("Call", "Assign", "AugAssign", *FUNCTION_KINDS), (
    "content_sha", "kind", "pre", "depth", "lineno", "ident", "params", "func_kind", "func_name",
    "recv_kind", "recv_name", "args", "kws", "targets", "value", "flow", "events", "runs",
))

SEED, ASSIGN, AUGMENT, SINK = range(4)
FAN_IN = 64  # summaries merged by one task
_STRINGS = "array<string>"


def _is_sink() -> Column:
    named = F.expr(P.among("func_name", (*OS_SHELL_FUNCTIONS, *SUBPROCESS_FUNCTIONS)))
    return (
        of_kind("Call") & named & P.is_shell_sink() & P.has_args() & P.holds("size(events) > 0")
    )


def taint_events(nodes: DataFrame) -> DataFrame:
    """What happens in each function, in its execution order.

    Parameters are tainted on entry (`*args` and `**kwargs` are not).  Assignments act where they
    stand.  A sink counts once for every simple statement around it: a nested function is also a
    statement of the function around it, so one call may count for both.
    """
    # Parameters are left out where no call could be a sink (`Uses`).
    is_call, is_def = of_kind("Call"), of_kind(*FUNCTION_KINDS) & F.col("params").isNotNull()
    moves = of_kind("Assign", "AugAssign") & F.col("flow").isNotNull()
    rows = rows_of(nodes, *TAINT_NEEDS.kinds).filter(_is_sink() | moves | is_def)
    no_strings = F.array().cast(_STRINGS)
    start = F.struct(
        F.struct("depth", "pre", F.col("ident").alias("name")).cast(FUNCTION).alias("fn"),
        F.array().cast("array<int>").alias("key"),
        F.when(F.col("runs").isNotNull(), 0).alias("run"),
    )
    places = F.when(is_call, F.col("events")).when(is_def, F.array(start.cast(FLOW)))
    stored = F.filter(F.transform("targets", lambda t: t["ident"]), lambda n: n.isNotNull())
    argument_names = F.flatten(F.transform("args", lambda a: a["names"]))
    return rows.select(
        "content_sha",
        F.explode(places.otherwise(F.array("flow"))).alias("place"),
        F.when(is_def, SEED).when(of_kind("Assign"), ASSIGN).when(is_call, SINK)
        .otherwise(AUGMENT).alias("step"),
        F.when(is_call, F.array("depth", "pre")).alias("order"),
        F.when(is_call, argument_names).when(is_def, no_strings)
        .otherwise(F.col("value.names")).alias("names"),
        F.when(is_def, F.col("params")).when(is_call, no_strings).otherwise(stored)
        .alias("targets"),
        F.col("lineno").alias("line"),
    ).select("content_sha", F.col("place.fn").alias("fn"), F.col("place.key").alias("key"),
             F.col("place.run").alias("run"), "step", "order", "names", "targets", "line")


def traced(events: list[dict]) -> Iterator[tuple[int, str, list[int]]]:
    """(line, name, position) of each sink that a tainted name reaches, events in order.

    An assignment that reads a tainted name taints its targets, any other clears them; an augmented
    assignment only taints.  A sink fires once, named after the first tainted name of its first
    tainted argument.
    """
    tainted: set[str] = set()
    for event in events:
        step, names, targets = event["step"], event["names"] or (), event["targets"] or ()
        if step == SINK:
            name = next((name for name in names if name in tainted), None)
            if name is not None:
                yield event["line"], name, _position(event)
        elif step == SEED or not tainted.isdisjoint(names):
            tainted.update(targets)
        elif step == ASSIGN:
            tainted.difference_update(targets)


Value = frozenset | None
TAINTED: Value = None  # a name that is tainted for certain


class Summary:
    """What a stretch of events does to the set of tainted names, whatever that set is.

    `sets` holds each name the stretch writes: tainted for certain, or tainted if one of a set of
    names is on entry (never, if that set is empty).  Other names keep their state.  `reads` are the
    names whose state on entry matters to the stretch or to a sink in it.
    """

    def __init__(self, sets: dict[str, Value] | None = None, reads: Iterable[str] = ()):
        self.sets = dict(sets or {})
        self.reads = set(reads)

    def value(self, name: str) -> Value:
        return self.sets.get(name, frozenset((name,)))

    def any_of(self, names: Iterable[str]) -> Value:
        """Whether one of `names` is tainted behind the stretch."""
        values = [self.value(name) for name in names]
        return TAINTED if TAINTED in values else frozenset().union(*values)

    def assign(self, step: int, names: Iterable[str], targets: Iterable[str]) -> None:
        value = TAINTED if step == SEED else self.any_of(names)
        if step == AUGMENT:
            self.sets.update([
                (t, TAINTED if value is TAINTED or self.value(t) is TAINTED
                 else self.value(t) | value)
                for t in targets])
        else:
            self.sets.update(dict.fromkeys(targets, value))

    def then(self, later: Summary) -> Summary:
        """This stretch and the one behind it as one."""
        met = [self.value(name) for name in later.reads]
        merged = Summary(self.sets, self.reads.union(*(v for v in met if v is not TAINTED)))
        merged.sets.update({
            name: TAINTED if value is TAINTED else self.any_of(value)
            for name, value in later.sets.items()
        })
        return merged

    def leave(self, tainted: set[str]) -> None:
        """Turn the names tainted before the stretch into those behind it."""
        held = {name for name, value in self.sets.items()
                if value is TAINTED or not value.isdisjoint(tainted)}
        tainted.difference_update(self.sets)
        tainted.update(held)


def summarised(events: list[dict]) -> tuple[Summary, list[tuple[dict, list[tuple[str, Value]]]]]:
    """The summary of a run, and its sinks with the names that may be tainted there, in order."""
    run, sinks = Summary(), []
    for event in events:
        names = event["names"] or ()
        if event["step"] != SINK:
            run.assign(event["step"], names, event["targets"] or ())
            continue
        chances = []
        for name in names:
            value = run.value(name)
            if value is TAINTED or value:
                chances.append((name, value))
            if value is TAINTED:
                break
        if chances:
            sinks.append((event, chances))
    values = [*run.sets.values(), *(value for _, chances in sinks for _, value in chances)]
    run.reads.update(*(value for value in values if value is not TAINTED))
    return run, sinks


_EFFECTS = "array<struct<name:string,tainted:boolean,sources:array<string>>>"
_FUNCTION = f"content_sha string, fn {FUNCTION}, run int"
_SUMMARIES = f"{_FUNCTION}, effects {_EFFECTS}, reads array<string>"
_TRACED = f"{_SUMMARIES}, line int, pos array<int>"
_ENTRIES = f"{_FUNCTION}, entry array<string>"


def _effects(values: Iterable[tuple[str, Value]]) -> list[dict]:
    return [{"name": name, "tainted": value is TAINTED, "sources": sorted(value or ())}
            for name, value in values]


def _row(summary: Summary) -> dict:
    return {"effects": _effects(summary.sets.items()), "reads": sorted(summary.reads)}


def _summary(row: dict) -> Summary:
    return Summary({e["name"]: TAINTED if e["tainted"] else frozenset(e["sources"])
                    for e in row["effects"]}, row["reads"])


def _position(event: dict) -> list[int]:
    return [*event["key"], *event["order"]]


def _map_rows(df: DataFrame, rows_of_group, ddl: str) -> DataFrame:
    """`rows_of_group(row)` for each row of `df`; the rows of a batch leave together."""
    if df.schema["content_sha"].dataType == LongType():  # a numbered node table
        ddl = ddl.replace("content_sha string", "content_sha bigint")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                out
                for cells in zip(*batch.columns)
                for out in rows_of_group(
                    {name: cell.as_py() for name, cell in zip(batch.schema.names, cells)})
            ]
            yield pa.RecordBatch.from_pylist(found, schema)

    return df.mapInArrow(run, ddl)


def _trace(group: dict) -> Iterator[dict]:
    """Hits of a whole function; of a run its summary and the sinks that may be hit."""
    base = {name: group[name] for name in ("content_sha", "fn", "run")}
    if group["run"] is None:
        for line, name, pos in traced(group["events"]):
            yield {**base, "line": line, "pos": pos, "effects": _effects([(name, TAINTED)])}
        return
    summary, sinks = summarised(group["events"])
    yield {**base, **_row(summary)}
    for event, chances in sinks:
        yield {**base, "line": event["line"], "pos": _position(event),
               "effects": _effects(chances)}


def _merge(group: dict) -> Iterator[dict]:
    merged = Summary()
    for part in group["parts"]:
        merged = merged.then(_summary(part))
    yield {**{name: group[name] for name in ("content_sha", "fn", "run")}, **_row(merged)}


def _enter(group: dict) -> Iterator[dict]:
    tainted = set(group["entry"] or ())
    for part in group["parts"]:
        summary = _summary(part)
        yield {"content_sha": group["content_sha"], "fn": group["fn"], "run": part["run"],
               "entry": sorted(tainted & summary.reads)}
        summary.leave(tainted)


def _neighbours(summaries: DataFrame) -> DataFrame:
    """FAN_IN summaries that follow each other, in one row."""
    return summaries.groupBy(
        "content_sha", "fn", F.expr(f"int(run div {FAN_IN})").alias("run")
    ).agg(F.sort_array(F.collect_list(F.struct("run", "effects", "reads"))).alias("parts"))


def entry_states(summaries: DataFrame, last_run: int) -> DataFrame:
    """(content_sha, fn, run, entry): of the names that a run reads, those tainted before it."""
    levels = [summaries]
    while last_run >= FAN_IN:
        levels.append(settled(_map_rows(_neighbours(levels[-1]), _merge, _SUMMARIES)))
        last_run //= FAN_IN
    # Nothing is tainted before the first run of a function.
    top = _neighbours(levels.pop()).withColumn("entry", F.array().cast(_STRINGS))
    entries = _map_rows(top, _enter, _ENTRIES)
    while levels:
        below = _neighbours(levels.pop()).join(
            spread(entries), ["content_sha", "fn", "run"])
        entries = _map_rows(below, _enter, _ENTRIES)
    return entries


def _traced(nodes: DataFrame, groups: Column) -> DataFrame:
    """What the fold finds in the functions and runs that `groups` selects."""
    event = F.struct("key", "step", "order", "names", "targets", "line")
    events = (
        taint_events(nodes)
        .groupBy("content_sha", "fn", "run")
        .agg(F.collect_list(event).alias("events"), F.max("step").alias("last"))
        .filter(((F.col("last") == SINK) | F.col("run").isNotNull()) & groups)
        .select("content_sha", "fn", "run", F.sort_array("events").alias("events"))
    )
    return _map_rows(events, _trace, _TRACED)


def _reached(runs: DataFrame) -> DataFrame:
    """The sinks of runs that a tainted name reaches."""
    last_run = runs.agg(F.max("run")).first()[0]
    if last_run is None:
        return runs.withColumn("name", F.lit(None).cast("string"))
    entries = entry_states(runs.filter(F.col("line").isNull()), last_run)
    tainted = F.filter("effects", lambda e: e["tainted"] | F.arrays_overlap(e["sources"], "entry"))
    sinks = runs.filter(F.col("line").isNotNull()).join(
        spread(entries), ["content_sha", "fn", "run"])
    return sinks.withColumn("name", F.get(tainted, F.lit(0))["name"]).filter(
        F.col("name").isNotNull()).drop("entry")


def taint_findings(nodes: DataFrame) -> DataFrame:
    """One row per sink that a tainted name reaches.

    Runs are needed several times.  A stored node table is read again for them, if it has any;
    straight from the parse job, what the fold finds is computed at once and kept.
    """
    in_run = F.col("run").isNotNull()
    if "family" in nodes.columns:
        whole = _traced(nodes, ~in_run)
        cut = rows_of(nodes, *FUNCTION_KINDS).filter(F.col("runs").isNotNull())
        runs = None if cut.isEmpty() else settled(_traced(nodes, in_run))
    else:
        found = settled(_traced(nodes, F.lit(True)))
        whole, runs = found.filter(~in_run), found.filter(in_run)
    hits = whole.withColumn("name", F.col("effects")[0]["name"])
    if runs is not None:
        hits = hits.unionByName(_reached(runs))
    return hits.select(
        "content_sha", F.lit("tainted_shell").alias("variant"), "line",
        F.lit(None).cast("string").alias("func"), F.lit(None).cast("string").alias("recv"),
        F.col("name").alias("var"), F.col("fn.name").alias("function_name"),
        F.concat(F.array("fn.depth", "fn.pre"), "pos").alias("pos"),
    )
