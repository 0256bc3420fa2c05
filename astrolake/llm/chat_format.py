"""Chat formatting: records of many layouts to one template, in DataFrame operations only.

A record is a VARIANT.  The fingerprint of its layout is a hash of its nested field paths; it selects
a declarative mapping, which turns the record into canonical turns (role, content).  The template
marks turns with control strings.  Control strings inside roles and texts are escaped by one
backslash behind their first character, in a way that can be undone, so the output can be read back
exactly.  The loss mask lists the assistant texts as ranges of the output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# What follows the first character of a control string: those of the template, and those of other
# common templates, which a tokenizer might know as special tokens.
_RESTS = (
    r"\|im_start\|>", r"\|im_sep\|>", r"\|im_end\|>", r"\|endoftext\|>", r"s>", r"/s>",
    r"INST\]", r"/INST\]", r"<SYS>>", r"</SYS>>",
)
_CONTROL = r"([<\[])(\\*)(" + "|".join(_RESTS) + ")"
_ESCAPED = r"([<\[])\\(\\*)(" + "|".join(_RESTS) + ")"

TURNS = "array<struct<role:string,content:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


@dataclass(frozen=True)
class Mapping:
    """A layout: its nested field paths, as `layout_paths` writes them, and its canonical turns."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Column], Column]


def _messages(record: Column) -> Column:
    return _get(record, "$.messages", TURNS)


def _exchange(record: Column) -> Column:
    said = _get(record, "$.conversations", "array<struct<from:string,value:string>>")
    return F.transform(said, lambda x: F.struct(
        F.when(x["from"] == "human", "user").when(x["from"] == "gpt", "assistant")
        .otherwise(x["from"]).alias("role"),
        x["value"].alias("content"),
    ))


def _pair(ask: str, reply: str) -> Callable[[Column], Column]:
    return lambda record: F.array(
        _turn("user", _get(record, f"$.{ask}")), _turn("assistant", _get(record, f"$.{reply}"))
    )


def _instruction(record: Column) -> Column:
    extra = _get(record, "$.input")
    ask = _get(record, "$.instruction")
    return F.array(
        _turn("user", F.when(F.coalesce(extra, F.lit("")) == "", ask)
              .otherwise(F.concat(F.coalesce(ask, F.lit("")), F.lit("\n\n"), extra))),
        _turn("assistant", _get(record, "$.output")),
    )


def _system_instruction(record: Column) -> Column:
    return F.array(
        _turn("system", _get(record, "$.system")), _turn("user", _get(record, "$.instruction")),
        _turn("assistant", _get(record, "$.output")),
    )


MAPPINGS = (
    Mapping("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>",
                         "OBJECT<messages: ARRAY<VOID>>"), _messages),
    Mapping("conversations", ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>",
                              "OBJECT<conversations: ARRAY<VOID>>"), _exchange),
    Mapping("prompt_completion", ("OBJECT<completion, prompt>",), _pair("prompt", "completion")),
    Mapping("prompt_response", ("OBJECT<prompt, response>",), _pair("prompt", "response")),
    Mapping("instruction", ("OBJECT<input, instruction, output>", "OBJECT<instruction, output>"),
            _instruction),
    Mapping("system_instruction", ("OBJECT<instruction, output, system>",), _system_instruction),
)


def layout_paths(record: Column) -> Column:
    """The nested field paths of a record, in order of name and without the types of values."""
    return F.regexp_replace(F.schema_of_variant(record), r": [A-Z]+(\([0-9,]+\))?(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(layout_paths(record))


def canonical_turns(df: DataFrame, record_column: str, mappings: tuple[Mapping, ...] = MAPPINGS,
                    layout_output: str = "layout", output: str = "turns") -> DataFrame:
    """`df` with the layout and the canonical turns of a VARIANT column.

    A record without a mapping has a null layout and null turns; a null record too.  Null roles and
    contents become empty.  Columns named like the outputs are replaced.
    """
    record = F.col(record_column)
    marked = df.withColumn("_print", fingerprint(record))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in reversed(mappings):
        fits = F.col("_print").isin([]) if not mapping.paths else None
        for paths in mapping.paths:
            same = F.col("_print") == F.xxhash64(F.lit(paths))
            fits = same if fits is None else fits | same
        layout = F.when(fits, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(fits, mapping.turns(record)).otherwise(turns)
    clean = F.transform(turns, lambda turn: F.struct(
        F.coalesce(turn["role"], F.lit("")).alias("role"),
        F.coalesce(turn["content"], F.lit("")).alias("content"),
    ))
    return marked.withColumns({layout_output: layout, output: clean}).drop("_print")


def render(df: DataFrame, turns_column: str = "turns", text_output: str = "formatted",
           loss_output: str = "loss") -> DataFrame:
    """`df` with the formatted text and the loss mask of a column of turns.

    The mask is an array of (start, length) in code points of the formatted text, one for each
    assistant turn.  Null turns give null.
    """
    pieces = F.transform(turns_column, lambda turn: F.struct(
        F.concat(F.lit(START), escape(turn["role"]), F.lit(MIDDLE)).alias("head"),
        escape(turn["content"]).alias("body"),
        (turn["role"] == "assistant").alias("learned"),
    ))
    framed = df.withColumn("_pieces", pieces)
    text = F.array_join(F.transform(
        "_pieces", lambda piece: F.concat(piece["head"], piece["body"], F.lit(END))), "")
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    walked = F.aggregate(
        "_pieces", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda state, piece: F.struct(
            (state["at"] + F.length(piece["head"]) + F.length(piece["body"]) + len(END)).alias("at"),
            F.when(piece["learned"], F.concat(state["spans"], F.array(F.struct(
                (state["at"] + F.length(piece["head"])).alias("start"),
                F.length(piece["body"]).cast("bigint").alias("length"),
            )))).otherwise(state["spans"]).alias("spans"),
        ),
    )
    return framed.withColumns({text_output: text, loss_output: walked["spans"]}).drop("_pieces")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(text, r"<\|im_end\|>")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part: F.struct(
        unescape(F.substring_index(F.substring_index(part, MIDDLE, 1), START, -1)).alias("role"),
        unescape(F.substring_index(part, MIDDLE, -1)).alias("content"),
    ))


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda span: unescape(F.substr(
        text, (span["start"] + 1).cast("int"), span["length"].cast("int")))), "")


def records_of_rows(df: DataFrame, id_column: str, turn_column: str, role_column: str,
                    text_column: str) -> DataFrame:
    """(id_column, record): one VARIANT per conversation of a table with a row per turn.

    The shape decides the layout: a question with its answer, the same under a system text, an
    exchange of the usual roles, and a list of messages for the rest.  Null texts and roles become
    empty; equal turn numbers are ordered by role and text; rows without id are one conversation.
    A conversation is one value, so it must fit in a row.
    """
    said = F.struct(
        F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("content"),
    )
    talks = df.groupBy(F.col(id_column).alias("_id")).agg(
        F.array_sort(F.collect_list(said)).alias("said")
    )
    roles = F.transform("said", lambda x: x["role"])
    content = [F.get("said", F.lit(i))["content"] for i in range(3)]

    def is_(*names: str) -> Column:
        return roles == F.array(*map(F.lit, names))

    usual = F.forall("said", lambda x: x["role"].isin("system", "user", "assistant"))
    record = F.when(is_("user", "assistant"), F.to_variant_object(F.struct(
        content[0].alias("prompt"), content[1].alias("completion")))).when(
        is_("system", "user", "assistant"), F.to_variant_object(F.struct(
            content[0].alias("system"), content[1].alias("instruction"),
            content[2].alias("output")))).when(
        usual & (F.pmod(F.size("said"), F.lit(2)) == 0), F.to_variant_object(F.struct(F.transform(
            "said", lambda x: F.struct(
                F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt")
                .otherwise(x["role"]).alias("from"),
                x["content"].alias("value"))).alias("conversations")))).otherwise(
        F.to_variant_object(F.struct(F.transform("said", lambda x: F.struct(
            x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))))
    return talks.select(F.col("_id").alias(id_column), record.alias("record"))
