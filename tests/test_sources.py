"""Listing filters, folder reading, path predicates, report sink, incremental scan."""

import os

import pytest
from pyspark.sql import functions as F

from astrolake.functions import paths
from astrolake.operators.scan import Scan
from astrolake.operators import views
from astrolake.operators.nodes import syntax_nodes, with_family
from astrolake.sources.code_files import (
    COLUMNS,
    code_files,
    read_folder,
    read_table,
    scannable,
    skipped_by_size,
)
from astrolake.sources.node_store import NodeStore
from astrolake.sources.report_sink import (
    drop_replaced_runs,
    finished_runs,
    read_report,
    replace_report,
    write_report,
)
from astrolake.streaming.incremental import incoming_files, scan_stream
from conftest import file_table

PLANTED = {
    "one.py": '"""Query."""\n\n\ndef get(conn, uid):\n    cur = conn.cursor()\n'
              '    cur.execute(f"SELECT * FROM users WHERE id = {uid}")\n    return cur',
    "two.py": "import os\n\n\ndef run(cmd):\n    os.system(cmd)",
    "three.py": 'ADMIN_PASSWORD = "correct horse battery"\nMAIL_KEY = "not-a-real-key"',
    "four.py": "import pickle\n\n\ndef load(c):\n    return pickle.loads(c.recv(9))",
    "five.py": "import hashlib\n\n\ndef h(p):\n    return hashlib.md5(p.encode()).hexdigest()",
    "six.py": "def calc(e):\n    result = eval(e)\n    return result",
    "seven.py": 'import os\n\n\ndef get(request):\n    name = request.args.get("f")\n'
                '    full = os.path.join("/var", name)\n    return open(full, "rb").read()',
    "eight.py": 'def rep(request):\n    name = request.form.get("r")\n    return open(name)',
}
EXPECTED = [
    ("eight.py", 3, "missing_input_validation"), ("eight.py", 3, "path_traversal"),
    ("five.py", 5, "weak_crypto"), ("four.py", 5, "insecure_deserialization"),
    ("one.py", 6, "sql_injection"), ("seven.py", 6, "path_traversal"),
    ("seven.py", 7, "missing_input_validation"), ("six.py", 2, "eval_exec_misuse"),
    ("three.py", 1, "hardcoded_secrets"), ("three.py", 2, "hardcoded_secrets"),
    ("two.py", 5, "command_injection_taint"),
]


def write_tree(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode() if isinstance(text, str) else text)


def test_folder_scan_end_to_end(spark, tmp_path):
    noise = {
        "pkg/__init__.py": "", "pkg/_private.py": "x = 1", "pkg/.hidden.py": "y = 1",
        "notes.txt": "eval(x)", "node_modules/a.py": "eval(x)", "pkg/build/b.py": "eval(x)",
        "x.egg-info/c.py": "eval(x)", ".py": "eval(x)", "big.py": "#" * 3000 + "\neval(x)",
        "broken.py": "def f(:",
    }
    write_tree(tmp_path, PLANTED | noise)
    files = read_folder(spark, str(tmp_path), "planted", max_file_bytes=2000)
    assert files.columns == list(COLUMNS)
    assert sorted(r.path for r in files.select("path").collect()) == sorted(
        [*PLANTED, "broken.py", "pkg/.hidden.py", "pkg/__init__.py", "pkg/_private.py"]
    )
    scan = Scan.full(files)
    found = scan.security_findings()
    rows = sorted((r.path, r.line, r.rule_id) for r in found.collect())
    assert rows == EXPECTED
    (dash,) = scan.dashboard().collect()
    assert (dash.files_found, dash.files_failed) == (12, 1)
    assert (dash.risk_score, dash.risk_label) == (53.1, "High Risk")
    assert (dash.critical, dash.high, dash.medium, dash.low) == (4, 3, 2, 2)


def test_folder_must_exist(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        read_folder(spark, str(tmp_path / "nowhere"), "r")


def test_table_filters_reach_the_scan(spark, tmp_path):
    files = file_table(spark, [("r", "a.py", "x = 1"), ("r", "a.txt", "x = 1"),
                               ("r", "venv/a.py", "x = 1"), ("r", "b.py", "y" * 50)])
    files.write.parquet(str(tmp_path / "files"))
    read = read_table(spark, str(tmp_path / "files"), max_file_bytes=20)
    assert [r.path for r in read.collect()] == ["a.py"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size_bytes,20)" in plan


PATHS = {
    # path: (extension, excluded, test)
    "a.py": (".py", False, False),
    "tests/a.py": (".py", False, True),
    "x/tests/a.py": (".py", False, True),
    "test/a.py": (".py", False, False),
    "test_a.py": (".py", False, True),
    "x/test_a.py": (".py", False, True),
    "a_test.py": (".py", False, True),
    "x\\tests\\a.py": (".py", False, True),
    "tests.py": (".py", False, False),
    "contest_a.py": (".py", False, False),
    ".git/a.py": (".py", True, False),
    "a/site-packages/b.py": (".py", True, False),
    "a/Build/b.py": (".py", False, False),
    "a/builds/b.py": (".py", False, False),
    "build": ("", False, False),
    "a.egg-info/b.py": (".py", True, False),
    "egg-info/b.py": (".py", True, False),
    "d.x/.py": ("", False, False),
    "a.PY": (".PY", False, False),
    "a.b.py": (".py", False, False),
    "a.py.": ("", False, False),
    ".venv": ("", False, False),
}


def test_path_predicates(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    path = F.col("path")
    rows = df.select(
        path, paths.extension(path).alias("e"), paths.in_excluded_directory(path).alias("x"),
        paths.is_test_path(path).alias("t"),
    ).collect()
    assert {r.path: (r.e, r.x, r.t) for r in rows} == PATHS


def test_custom_limits(spark):
    df = spark.createDataFrame([("a.pyi", 5), ("gen/a.pyi", 5), ("a.py", 5)],
                               "path string, size_bytes long")
    kept = scannable(df, extensions=["pyi"], excludes=["gen"])
    assert [r.path for r in kept.collect()] == ["a.pyi"]


def test_repository_urls(spark):
    labels = {
        "https://github.com/a/b": True, " https://github.com/a.b/c-d.git/\n": True,
        "git@github.com:a/b.git": True, "git@github.com:a/b": False, "./a/b": False,
        "https://github.com/a": False, "https://github.com/a/b/c": False,
        "https://github.com/ä/ß": True, "http://github.com/a/b": False,
    }
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    rows = df.select("label", paths.is_repository_url(F.col("label")).alias("ok")).collect()
    assert {r.label: r.ok for r in rows} == labels


def test_report_tables(spark, tmp_path):
    files = file_table(spark, [("r", name, text) for name, text in PLANTED.items()])
    write_report(Scan.full(files), str(tmp_path / "report"))
    base = str(tmp_path / "report")
    findings = spark.read.parquet(f"{base}/security_findings")
    assert findings.count() == 11
    assert {d for d in os.listdir(f"{base}/security_findings") if "=" in d} == {
        f"by_effective_severity={t}" for t in ("critical", "high", "medium", "low")
    }
    (dash,) = spark.read.parquet(f"{base}/dashboard").collect()
    assert (dash.security_findings, dash.risk_score) == (11, 53.1)
    counts = spark.read.parquet(f"{base}/category_counts").orderBy("position").collect()
    assert [(r.rule_id, r.n, r.share) for r in counts][:2] == [
        ("hardcoded_secrets", 2, 100.0), ("missing_input_validation", 2, 100.0),
    ]


def test_incremental_scan(spark, tmp_path):
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    schema = "repo_id string, path string, content binary"

    def arrive(names):
        rows = [("r", n, bytearray(PLANTED[n].encode())) for n in names]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(drop)

    def run():
        scan_stream(incoming_files(spark, drop), out, str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(f"{out}/security_findings").count()

    arrive(["one.py", "two.py", "three.py"])
    assert run() == 4
    assert run() == 4
    arrive(["four.py", "five.py", "six.py", "seven.py", "eight.py"])
    assert run() == 11


def test_large_files_are_scanned_unless_a_cap_is_asked_for(spark):
    large = "#" * 2_100_000 + "\neval(x)\n"
    files = file_table(spark, [("r", "big.py", large), ("r", "small.py", "eval(x)")])
    found = Scan(scannable(files)).rule("eval_exec_misuse").collect()
    assert sorted(r.path for r in found) == ["big.py", "small.py"]
    skipped = skipped_by_size(files, 2_000_000).collect()
    assert [(r.path, r.reason) for r in skipped] == [("big.py", "larger than 2000000 bytes")]


def test_views_give_lines_of_any_length(spark):
    long = "run(a, '" + "x" * 5000 + "')"
    files = file_table(spark, [("r", "a.py", f"if c:\n    {long}\n    y = run(b)\n")])
    nodes = syntax_nodes(files, views.CALLS | views.LINES)
    rows = views.with_text(views.calls(nodes), nodes).collect()
    assert sorted(r.text for r in rows) == sorted([long, "y = run(b)"])


def test_equal_contents_are_parsed_once_without_sorting_them(spark):
    files = file_table(spark, [("r", f"{i}.py", "x = 1") for i in range(50)] + [("s", "0.py", "y")])
    files = files.unionAll(files)
    nodes = syntax_nodes(files, views.KIND_COUNTS)
    assert nodes.filter("kind = 'Module'").count() == 2
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def findings_of(scan):
    rows = scan.security_findings().drop("fix_suggestion").collect()
    return sorted(map(str, rows)) + sorted(map(str, scan.quality_findings().collect()))


def test_store_parses_only_new_contents(spark, tmp_path):
    old = [("r", f"{i}.py", f"import os\nx = {i}\nos.system('ls' + x)\n") for i in range(200)]
    new = [("r", "new.py", "eval(x)\n"), ("s", "broken.py", "def f(:"), ("s", "copy.py", old[3][2])]
    folder = str(tmp_path / "store")
    first = Scan.full(file_table(spark, old), folder)
    held = NodeStore(spark, folder, first.needs)
    assert first.status().count() == 200
    files = file_table(spark, old + new)
    again = Scan.full(files, folder)
    assert findings_of(again) == findings_of(Scan.full(files))
    sizes = held.contents().groupBy("batch").count().collect()
    assert sorted(row["count"] for row in sizes) == [2, 200]
    assert held.add(files).count() == 0
    assert len(held._batches()) == 2
    few = file_table(spark, new)
    assert findings_of(Scan.full(few, folder)) == findings_of(Scan.full(few))
    assert again.dashboard().orderBy("repo_id").collect() == \
        Scan.full(files).dashboard().orderBy("repo_id").collect()


def test_store_survives_failed_and_concurrent_runs(spark, tmp_path):
    files = file_table(spark, [("r", "a.py", "eval(x)\n"), ("r", "b.py", "exec(x)\n")])
    folder = str(tmp_path / "store")
    plain = Scan.full(files)
    held = NodeStore(spark, folder, plain.needs)
    lost = with_family(syntax_nodes(files, plain.needs))
    lost.write.partitionBy("family").parquet(f"{held.base}/nodes/batch=lost")
    wanted = findings_of(plain)
    assert findings_of(Scan.full(files, folder)) == wanted
    # another run had parsed the same contents and ends now
    files.select("content_sha").write.parquet(f"{held.base}/contents/batch=lost")
    assert held.contents().count() == 2
    assert findings_of(Scan.full(files, folder)) == wanted
    none = files.filter("path = 'none'")
    assert findings_of(Scan.full(none, str(tmp_path / "empty"))) == []


def test_stream_with_a_store_parses_copies_once(spark, tmp_path):
    drop, folder = str(tmp_path / "drop"), str(tmp_path / "store")
    schema = "repo_id string, path string, content binary"
    found = lambda out: sorted(map(str, spark.read.parquet(
        f"{out}/security_findings").drop("batch_id").collect()))
    for repo in ("r", "s"):
        rows = [(repo, n, bytearray(t.encode())) for n, t in PLANTED.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(drop)
        scan_stream(incoming_files(spark, drop), str(tmp_path / "kept"), str(tmp_path / "c1"),
                    folder).awaitTermination()
    scan_stream(incoming_files(spark, drop), str(tmp_path / "plain"),
                str(tmp_path / "c2")).awaitTermination()
    assert len(found(tmp_path / "kept")) == 22
    assert found(tmp_path / "kept") == found(tmp_path / "plain")
    held = NodeStore(spark, folder, Scan.full(file_table(spark, [])).needs)
    sizes = [row["count"] for row in held.contents().groupBy("batch").count().collect()]
    assert sizes == [len(PLANTED)]


def test_report_is_replaced_by_repository(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = [(repo, name, text) for repo in ("a", "b", "c") for name, text in PLANTED.items()]
    table = lambda name: read_report(spark, path, name)

    def count(name="security_findings"):
        return {r.repo_id: r["count"] for r in table(name).groupBy("repo_id").count().collect()}

    with pytest.raises(FileNotFoundError):
        table("dashboard")
    replace_report(Scan.full(file_table(spark, rows)), path)
    before = {name: sorted(map(str, table(name).filter("repo_id <> 'b'").collect()))
              for name in ("security_findings", "findings_by_tier", "dashboard", "category_counts")}
    assert count() == {"a": 11, "b": 11, "c": 11}

    # a run that ends before its manifest changes nothing
    one = file_table(spark, [("b", "one.py", PLANTED["one.py"])])
    write_report(Scan.full(one), f"{path}/runs/run=00000002-0f")
    assert count() == {"a": 11, "b": 11, "c": 11}

    replace_report(Scan.full(one), path)
    assert count() == {"a": 11, "b": 1, "c": 11}
    for name, kept in before.items():
        assert sorted(map(str, table(name).filter("repo_id <> 'b'").collect())) == kept
    assert table("dashboard").filter("repo_id = 'b'").first().risk_score == 7.0

    # a repository without a file left loses its rows, one without findings keeps its dashboard row
    clean = file_table(spark, [("c", "x.py", "x = 1")])
    replace_report(Scan.full(clean), path, spark.createDataFrame([("a",)], "repo_id string"))
    assert count() == {"b": 1} and count("dashboard") == {"b": 1, "c": 1}
    runs = finished_runs(spark, path)
    assert drop_replaced_runs(spark, path) == runs[:1]
    assert count() == {"b": 1} and finished_runs(spark, path) == runs[1:]


def test_rows_without_a_repository_stay_in_the_report(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = [(None, "a.py", "eval(x)\n"), ("b", "b.py", "eval(x)\n")]
    replace_report(Scan.full(file_table(spark, rows)), path)
    replace_report(Scan.full(file_table(spark, rows[1:])), path)
    found = read_report(spark, path, "security_findings").collect()
    assert sorted((str(r.repo_id), r.path) for r in found) == [("None", "a.py"), ("b", "b.py")]


def test_replaced_report_without_findings(spark, tmp_path):
    path = str(tmp_path / "report")
    replace_report(Scan.full(file_table(spark, [("a", "x.py", "x = 1")])), path)
    assert read_report(spark, path, "security_findings").count() == 0
    with pytest.raises(ValueError):
        read_report(spark, path, "nothing")


def test_full_scan_makes_texts_for_listing_and_parse_only(spark):
    """Everything behind the parse job reads the listing: no text is made or hashed again."""
    made = spark.range(20).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo_id"),
        F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit(".py")).alias("path"),
        F.encode(F.concat(F.lit("x = 1\neval(x) #"), (F.col("id") % 7).cast("string")), "UTF-8")
        .alias("content"),
    )
    files = code_files(made)
    with Scan.full(files) as scan:
        results = scan.security_findings(), scan.quality_findings(), scan.dashboard(), \
            scan.security_counts(), scan.quality_counts()
        for result in results:
            assert "sha2" not in result._jdf.queryExecution().optimizedPlan().toString()
        assert results[0].count() == 20
        assert len(set(findings_of(scan))) == 20
    with Scan.full(files.filter("path <> 'src/m3.py'")) as scan:
        assert scan.nodes.filter("kind = 'Module'").count() == 7


def test_store_looks_for_fresh_contents_in_the_listing(spark, tmp_path):
    files = file_table(spark, [("r", f"{n}.py", f"eval(x + {n % 5})\n") for n in range(12)])
    listing = files.select("repo_id", "path", "content_sha")
    held = NodeStore(spark, str(tmp_path / "store"), Scan.full(files).needs)
    assert held.add(files.filter("path < '2'")).count() == 2  # 0, 1, 10 and 11
    assert held.add(files, listing).count() == 3
    assert held.add(files, listing).count() == 0
