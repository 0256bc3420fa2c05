"""What a full scan keeps on disk: less, with the same findings."""

import inspect
import os
import pickle
import random
import subprocess
import tarfile
import zipfile
from collections import Counter

import pytest
from conftest import file_table

from astrolake.operators import findings, quality
from astrolake.operators.function_rules import FUNCTION_RULE_NEEDS, function_findings
from astrolake.operators.nodes import STATUS, syntax_nodes
from astrolake.operators.scan import Scan, _long, _short
from astrolake.session import settled, write_files
from astrolake.sources.case_corpus import CASES
from astrolake.sources.node_store import NodeStore
from astrolake.sources.report_sink import write_report

MORE = (
    "import os\n\ndef f(a):\n    ｓystem = a\n    os.ｓystem(a)\n",  # identifiers are normalised
    "# coding: utf-7\n\ndef f(a):\n    import os\n    os.+AHMAeQBzAHQAZQBt-(a)\n",
    "def f(a):\n    b = c = 1\n    d: int = 2\n    e: int\n    f += 1\n    g = h = 'x'\n"
    "    def i():\n        return b, d, lambda: g\n    class J:\n        k = 1\n        l = k\n",
    "class A:\n    api_key = 'x'\n    def f(self, password='p'):\n        self.token = 'y'\n"
    "        raise E\n        if 0:\n            pass\n        elif 1:\n            return\n        else:\n"
    "            x = 3\n",
    "x = C.new(a, b, mode=MODE_ECB)\ny = C.other(z, AES.MODE_ECB)\ny(*AES.MODE_ECB, m=A.MODE_ECB)\n",
    "def f(p):\n    q = input()\n    if p in q or '..' not in q:\n        open(q)\n    eval(q)\n",
    "import subprocess as s, os\ndef f(a):\n    b = a\n    with s:\n        s.run(b, shell=True)\n"
    "    subprocess.run(b, shell=True)\n    def g(c):\n        os.popen(c + b)\n",
)


@pytest.fixture(scope="module")
def files(spark):
    modules = (inspect, os, pickle, random, subprocess, tarfile, zipfile)
    texts = [inspect.getsource(m) for m in modules] + list(MORE)
    texts += [bytes.fromhex(first) + text.replace("{k}", "7").encode(charset)
              for _, first, charset, text in CASES]
    return file_table(spark, [("r", f"{n % 5}/{n}.py", text) for n, text in enumerate(texts)] + [
        ("s", "copy.py", texts[3]), ("s", "tests/test_copy.py", texts[-2])])


def found(scan):
    return [Counter(map(str, rows.collect())) for rows in (
        scan.security_findings(), scan.quality_findings(), scan.status(), scan.dashboard())]


def test_rows_no_rule_uses_are_left_out(spark, files, monkeypatch):
    monkeypatch.setattr(findings, "EXTRA_RULES", {})
    with Scan.full(files) as scan, Scan(files, scan.needs._replace(uses=None)) as whole:
        assert found(scan) == found(whole)
        assert len(scan.security_findings().collect()) > 40
        assert scan.nodes.count() < whole.nodes.count() / 2
        assert scan.nodes.where("kind = '#line'").count() < whole.nodes.where("kind = '#line'").count() / 2
        assert scan.nodes.where("kind = 'Module'").count() == whole.nodes.where("kind = 'Module'").count()


def test_rules_of_a_user_see_all_rows(files, monkeypatch):
    monkeypatch.setattr(findings, "EXTRA_RULES", {"mine": (STATUS, None, [])})
    assert Scan.full(files).needs.uses is None


def test_contents_are_numbered(spark, files):
    """The hash of a content is stored once for it, not with each row and file."""
    with Scan.full(files) as scan:
        assert dict(scan.nodes.dtypes)["content_sha"] == "bigint"
        assert dict(scan.listing.dtypes)["content_sha"] == "bigint"
        assert scan.nodes.where("hash is not null").count() == files.select("content_sha").distinct().count()
        status = {r.content_sha for r in scan.status().collect()}
        assert status == {r.content_sha for r in files.select("content_sha").collect()}
        assert scan.listing.count() == files.count()
        assert not any("/astrolake/files-" in table for table in scan._tables)


def test_numbers_of_other_hashes(spark):
    names = ["ab", "AB", "", "ab" * 32, "AB" * 32, "x" * 32, "\0" * 64, "é", None]
    rows = spark.createDataFrame([(name,) for name in names], "name string")
    keys = rows.select("name", _short(rows["name"]).alias("key"))
    kept = keys.select("name", "key", _long(keys["key"]).alias("again")).collect()
    assert all(row.again == row.name for row in kept)
    assert len({bytes(row.key) for row in kept if row.key is not None}) == len(names) - 1
    files = file_table(spark, [("r", "a.py", "eval(x)"), ("r", "b.py", "def f(:")])
    files = files.unionByName(file_table(spark, [("s", "c.py", "x")]).selectExpr(
        "repo_id", "path", "size_bytes", "cast(null as binary) content",
        "cast(null as string) content_sha", "is_test"))
    with Scan.full(files) as scan:
        assert {(r.repo_id, r.files_found, r.files_parsed) for r in scan.dashboard().collect()} == {
            ("r", 2, 1), ("s", 1, 0)}
        assert scan.status().count() == 2


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    files = context.env().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {name for name in files.split() if "/shuffle_" in name}


def test_shuffle_files_go_with_their_step(spark, files, tmp_path):
    before = shuffled(spark)
    wide = spark.range(1000).repartition(5, "id")
    write_files(wide, str(tmp_path / "table"))
    assert settled(wide).count() == 1000
    with Scan.full(files) as scan:
        write_report(scan, str(tmp_path / "report"))
        scan.dashboard()
    left = shuffled(spark) - before
    assert len({name.split("/shuffle_")[1].split("_")[0] for name in left}) < 5


def test_unused_names_of_nested_functions(spark):
    """A read counts for every function around it, whichever reads of a name are left out."""
    text = ("def f():\n    a = 1\n    b = 1\n    def g():\n        a = 2\n        return b\n"
            "    def h():\n        c = 1\n        return a\n    return c\n")
    table = file_table(spark, [("r", "a.py", text)])
    with Scan.full(table) as scan:
        kept = quality.unused_vars(scan.nodes).collect()
    whole = quality.unused_vars(syntax_nodes(table, quality.NAME_NEEDS)).collect()
    assert sorted((r.line, r["var"], r.function_name) for r in kept) == sorted(
        (r.line, r["var"], r.function_name) for r in whole) != []


def test_function_rules_are_hashed(spark):
    """The first sink in the walk comes without sorting rows by function."""
    text = ("def f():\n    q = input()\n    for x in q:\n        if x:\n            eval(x)\n"
            "        open(q)\n    while q:\n        exec(q)\n")
    rows = syntax_nodes(file_table(spark, [("r", "a.py", text)]), FUNCTION_RULE_NEEDS)
    hits = function_findings(rows)
    assert {(r.variant, r.line) for r in hits.collect()} == {
        ("unvalidated_input", 6), ("unchecked_path", 6)}
    assert "SortAggregate" not in hits._jdf.queryExecution().executedPlan().toString()


def test_store_finds_fresh_contents_once(spark, files, tmp_path):
    """What is new is worked out in one step and kept for the parse job."""
    some = files.where("repo_id = 's'")
    needs = Scan.full(files).needs
    held = NodeStore(spark, str(tmp_path / "store"), needs)
    assert held.add(some).count() == 2
    known, made = [], NodeStore._read
    held._read = lambda *a: known.append(a[0]) or made(held, *a)
    distinct = files.select("content_sha").distinct().count()
    assert held.add(files).count() == distinct - 2
    assert known == ["contents"]
    assert held.contents().groupBy("batch").count().count() == 2
    assert held.add(files).count() == 0
    with Scan.full(files, str(tmp_path / "store")) as scan, Scan.full(files) as plain:
        assert found(scan) == found(plain)


def test_scans_without_status_rows_keep_hashes(spark, files):
    """No row tells the numbers there."""
    with Scan.quality(files) as scan, Scan.full(files) as full:
        kept, whole = scan.quality_findings().collect(), full.quality_findings().collect()
    assert len(kept) > 20 and Counter(map(str, kept)) == Counter(map(str, whole))
    with Scan(files.where("repo_id = 's'")) as scan:
        assert dict(scan.nodes.dtypes)["content_sha"] == "string"
        assert scan.quality_findings().count() == sum(row.repo_id == "s" for row in whole)
