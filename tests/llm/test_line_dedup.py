"""Line dedup against a plain loop."""

import re
from collections import defaultdict

from astrolake.llm.line_dedup import (
    DEPTH, LONG, LONG_DOCS, MIN_DOCS, MIN_FIELDS_FIXED, MIN_FIXED, drop_recurring_lines, templates,
)


def keys_of(line):
    """(key, documents it needs) of a line."""
    bare = line.replace("\t", " ").replace("\r", " ").strip(" ")
    if not bare:
        return []
    tokens = re.sub("[^ ]*[0-9][^ ]*", "<*>", bare).split(" ")
    n, fixed = len(tokens), len(tokens) - " ".join(tokens).count("<*>")
    whole = tokens if 2 * fixed >= n and fixed >= MIN_FIELDS_FIXED else bare.split(" ")
    leaf = (n, *tokens[:DEPTH])
    out = [((leaf, "whole", *whole), LONG_DOCS if n >= LONG else MIN_DOCS)]
    rest = max(n - DEPTH, 0)
    wide = min(-(-rest // 3), n * 3 // 10)
    if wide and 3 * (fixed - wide) >= 2 * n and fixed - wide >= MIN_FIXED:
        for number, start in enumerate((0, (rest - wide) // 2, rest - wide)):
            cut = DEPTH + start
            out.append(((leaf, number, *tokens[:cut], None, *tokens[cut + wide:]), MIN_DOCS))
    return out


def expected(rows):
    docs, first = defaultdict(set), {}
    for doc, text in rows:
        for at, line in enumerate(text.split("\n")) if text is not None else ():
            for key, _ in keys_of(line):
                place = (doc is None, doc or 0, text, at)
                docs[key].add((doc, text))
                first[key] = min(first.get(key, place), place)
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        kept = [
            line for at, line in enumerate(text.split("\n")) if not any(
                len(docs[key]) >= least and first[key] != (doc is None, doc or 0, text, at)
                for key, least in keys_of(line))
        ]
        out.append((doc, "\n".join(kept)))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.text) for r in drop_recurring_lines(df, "doc_id", "text").collect()]


def key(row):
    return str(row)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = run(spark, rows)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    assert sum(a[1] != b[1] for a, b in zip(sorted(rows), sorted(got))) > 50


def test_templates_generalise_variable_fields(spark):
    common = "served from cache node alpha in the east region after retry"
    rows = [(i, f"GET /page/{i} took {i * 7} ms status 200\nown line of {'abcdef'[i]}\n"
                f"{common} {'uvwxyz'[i]} {'qrstuv'[i]}") for i in range(6)]
    got = dict(run(spark, rows))
    assert got[0] == rows[0][1]
    for i in range(1, 6):
        assert got[i] == f"own line of {'abcdef'[i]}"


def test_two_documents_are_no_recurrence(spark):
    rows = [(1, "same line here"), (2, "same line here"), (3, "other")]
    assert sorted(run(spark, rows)) == rows


def test_lines_that_must_stay(spark):
    """Stated independently of the templates: what these lines say stands nowhere else."""
    head = "we met the whole team in the old harbour office on that day"
    rows = [
        (1, "12 340 7\n2021-03-04\nTotal 45.30\n" + head + " and spoke about the budget of the new"
            " wing until late at night"),
        (2, "99 1 2\n2019-01-02\nTotal 17.00\n" + head + " before anna presented her plans for two"
            " gardens behind the main house"),
        (3, "5 6 7\n1987-07-08\nTotal 3.99\n" + head + " while rain fell without end so nobody could"
            " leave for home by boat"),
    ]
    assert sorted(run(spark, rows)) == rows


def test_equal_rows_of_numbers_and_boilerplate_go(spark):
    notice = "all rights are reserved by the owner and no part may be copied without written leave"
    rows = [(i, f"1 2 3\n{notice}\nown {'abc'[i]}") for i in range(3)]
    got = dict(run(spark, rows))
    assert got == {0: rows[0][1], 1: "own b", 2: "own c"}


def test_fields_within_one_window_are_open(spark):
    rows = [(i, f"this page was written by {name} for the readers of our small weekly paper")
            for i, name in enumerate(["ann", "bob", "cyd"])]
    assert dict(run(spark, rows)) == {0: rows[0][1], 1: "", 2: ""}


def test_a_passage_recurs_in_two_documents(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, passage + "\nx"), (2, "y\n" + passage)]
    assert sorted(run(spark, rows)) == [rows[0], (2, "y")]


def test_a_long_text_of_one_line(spark):
    rows = [(i, "word " * 400_000 + "abc"[i]) for i in range(2)] + [(3, None)]
    assert sorted(run(spark, rows)) == sorted(rows)


def test_nulls_empty_texts_repeats_and_order(spark):
    rows = [(None, "a b\n\nc"), (1, None), (2, ""), (3, "a b\r"), (4, "a b\n\na b"), (4, "a b\n\na b"),
            (5, "\n")]
    got = run(spark, rows)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    assert (3, "a b\r") in got and (None, "\nc") in got and (4, "") in got


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "x", 1, 2, 3)],
                               "doc_id long, text string, _line int, leaf int, first int")
    assert drop_recurring_lines(df, "doc_id", "text").collect() == df.collect()
    assert drop_recurring_lines(df.limit(0), "doc_id", "text").collect() == []


def test_a_leaf_takes_four_bytes_of_a_row(spark):
    """Its lower half is zero, so that it compresses with its neighbours; other lines differ in it."""
    lines = spark.createDataFrame([(f"{a} {b} tail",) for a in "abcdef" for b in "uvwxyz"], "_line string")
    leaves = {r.leaf for r in templates(lines).collect()}
    assert len(leaves) == 36 and all(leaf % (1 << 32) == 0 for leaf in leaves)
