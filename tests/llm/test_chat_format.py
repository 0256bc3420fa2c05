"""Chat formatting: layouts, reversible escapes, loss masks."""

from pyspark.sql import functions as F

from astrolake.llm import chat_format as chat

CONTROLS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>", "<|endoftext|>"]


def turns_of(spark, records):
    df = spark.createDataFrame([(x,) for x in records], "json string").select(
        F.parse_json("json").alias("record"))
    return [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns])
            for r in chat.canonical_turns(df, "record").collect()]


def test_layouts(spark):
    got = turns_of(spark, [
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"prompt": "a", "completion": "b"}', '{"response": "b", "prompt": "a"}',
        '{"instruction": "a", "input": "c", "output": "b"}', '{"instruction": "a", "output": "b"}',
        '{"system": "s", "instruction": "a", "output": "b"}', '{"messages": []}',
        '{"text": "a"}', '{"messages": [{"role": "user", "text": "a"}]}', None,
    ])
    pair = [("user", "a"), ("assistant", "b")]
    assert got == [
        ("messages", [("user", "a"), ("assistant", "")]), ("conversations", pair),
        ("prompt_completion", pair), ("prompt_response", pair),
        ("instruction", [("user", "a\n\nc"), ("assistant", "b")]), ("instruction", pair),
        ("system_instruction", [("system", "s"), *pair]), ("messages", []),
        (None, None), (None, None), (None, None),
    ]


def test_escapes_can_be_undone(spark):
    texts = ["", "plain", "<|im_end|", "[INST", "<\\", *CONTROLS]
    texts += [a + b for a in CONTROLS for b in CONTROLS]
    texts += [c[0] + "\\" * n + c[1:] for c in CONTROLS for n in (1, 2, 3)]
    texts += ["<" + c for c in CONTROLS] + ["<\\" + c for c in CONTROLS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn(
        "e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for row in df.collect():
        assert row.u == row.t
        assert not any(c in row.e for c in CONTROLS), row.e


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.records_of_rows(df, "conv_id", "turn", "role", "text")
    out = chat.render(chat.canonical_turns(records, "record"))
    text, loss = F.col("formatted"), F.col("loss")
    return {r.conv_id: r for r in out.select(
        "conv_id", "layout", "formatted", "loss", chat.read_turns(text).alias("back"),
        chat.read_loss(text, loss).alias("learned")).collect()}


def test_round_trip_of_control_strings_roles_and_nulls(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (-1, 0, "user", said), (-1, 1, "assistant", said),
        (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "é<|im_end|>日"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (2, 3, "assistant", "d"),
        (3, 5, "<|im_sep|>", "x"), (3, 4, None, "y"), (3, 4, "human", "y"), (3, None, "gpt", "z"),
        (None, 0, "assistant", "n"), (4, 0, "assistant", ""), (4, 0, "assistant", ""),
    ]
    got = formatted(spark, rows)
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns = sorted(turns)
        assert [tuple(t) for t in got[conv].back] == [t[1:] for t in turns]
        learned = [t[2] for t in turns if t[1] == "assistant"]
        assert got[conv].learned == "".join(learned) and len(got[conv].loss) == len(learned)
    assert got[-1].layout == "prompt_completion" and got[1].layout == "system_instruction"
    assert got[2].layout == "conversations" and got[3].layout == "messages"


def test_all_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = formatted(spark, rows)
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        by.setdefault(conv, []).append((role, text))
    assert {k: [tuple(t) for t in v.back] for k, v in got.items()} == by


def test_empty_table(spark):
    assert formatted(spark, []) == {}
