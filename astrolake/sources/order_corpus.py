"""A corpus of source files derived from the `orders` table, one file per order.

Sixteen file shapes with a size parameter.  The findings of every file follow from its key, which
gives each operator an expected result that does not depend on parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.sources.code_files import code_files

# File shapes; {k} is the order key.  Shapes 11 to 13 also have generated middle lines.
SHAPES = {
    0: 'def load_{k}(conn, uid):\n    cur = conn.cursor()\n'
       '    return cur.execute(f"SELECT * FROM t WHERE id = {uid}")',
    1: 'import os\n\ndef show_{k}(name):\n    os.popen("ls " + name)',
    2: 'import subprocess\n\ndef run_{k}():\n    subprocess.call("ls -la", shell=True)',
    3: 'DB_PASSWORD_{k} = "pw-{k}-abcdef"\nSERVICE_TOKEN = "tok-{k}-abcdef"\nTITLE = "report"',
    4: 'import pickle\n\ndef load_{k}(raw):\n    return pickle.loads(raw)',
    5: 'import hashlib\n\ndef h_{k}(data):\n    return hashlib.md5(data).hexdigest()',
    7: 'import os\n\ndef get_{k}(request):\n    name = request.args.get("f")\n'
       '    full = os.path.join("/srv", name)\n    return open(full)',
    8: 'def get_{k}(request):\n    name = request.form.get("f")\n    if ".." in name:\n'
       '        raise ValueError(name)\n    return open(name)',
    9: 'import os\n\ndef diag_{k}(cmd):\n    os.system(cmd)',
    10: 'import os\n\ndef diag_{k}(cmd):\n    cmd = "ls"\n    os.system(cmd)',
    15: 'def broken_{k}(:\n    pass',
}
EVAL_DYNAMIC = "def calc_{k}(expr):\n    return eval(expr)"
EVAL_LITERAL = 'def calc_{k}(expr):\n    return eval("1 + 1")'
DEAD_AFTER = 'def e_{k}():\n    return 1\n    print("never")'
DEAD_IF = 'def e_{k}():\n    if False:\n        print("never")\n    return 1'


def _key() -> Column:
    return F.col("o_orderkey")


def _repeated(count: Column, line) -> Column:
    """`line(i)` for i in 0..count-1, joined; empty when count is 0."""
    lines = F.transform(F.sequence(F.lit(0), count), line)
    return F.array_join(F.slice(lines, 1, count), "")


def _text() -> Column:
    shape = (_key() % 16).cast("int")
    size = (F.floor(_key() / 16) % 15).cast("int")

    def branch(i: Column) -> Column:
        return F.concat(F.lit("\n    if x == "), i.cast("string"),
                        F.lit(":\n        x = x + 1"))

    def nested(i: Column) -> Column:
        return F.concat(F.lit("\n"), F.repeat(F.lit("    "), i + 1), F.lit("if x > "),
                        i.cast("string"), F.lit(":"))

    def unused(i: Column) -> Column:
        number = i.cast("string")
        return F.concat(F.lit("\n    v"), number, F.lit(" = "), number)

    depth, stores = size % 8, size % 4
    generated = {
        6: F.when(size % 2 == 0, F.lit(EVAL_DYNAMIC)).otherwise(F.lit(EVAL_LITERAL)),
        11: F.concat(F.lit("def c_{k}(x):"), _repeated(size, branch),
                     F.lit("\n    return x")),
        12: F.concat(F.lit("def d_{k}(x):"), _repeated(depth, nested), F.lit("\n"),
                     F.repeat(F.lit("    "), depth + 1), F.lit("return x")),
        13: F.concat(F.lit("def u_{k}():"), _repeated(stores, unused),
                     F.lit("\n    return 0")),
        14: F.when(size % 2 == 0, F.lit(DEAD_AFTER)).otherwise(F.lit(DEAD_IF)),
    }
    out = F.when(shape == 0, F.lit(SHAPES[0]))
    for number in range(1, 16):
        out = out.when(
            shape == number,
            generated[number] if number in generated else F.lit(SHAPES[number]),
        )
    return F.replace(out, F.lit("{k}"), _key().cast("string"))


def _repo(groups: int | None) -> Column:
    owner = F.col("o_custkey") if groups is None else F.col("o_custkey") % groups
    return F.concat(F.lit("repo_"), owner.cast("string"))


def _path() -> Column:
    key = _key().cast("string")
    return F.when(_key() % 5 == 0, F.concat(F.lit("tests/test_"), key, F.lit(".py"))).otherwise(
        F.concat(F.lit("src/mod_"), key, F.lit(".py"))
    )


def corpus(spark: SparkSession, sf_dir: str, repositories: int | None = 40) -> DataFrame:
    """File table of the corpus; with `repositories=None` every customer is a repository.

    The text comes out of an `explode` of one element: a filter on a plain expression would move
    below the exchange and repeat the whole expression in each of its terms.
    """
    return code_files(
        _orders(spark, sf_dir).select(
            _repo(repositories).alias("repo_id"), _path().alias("path"),
            F.explode(F.array(F.encode(_text(), "UTF-8"))).alias("content"),
        )
    )


# Directory and file name parts for the listing filters, chosen by the order key.
DIRECTORIES = (
    "src", "node_modules/pkg", "lib/build", ".git/hooks", "pkg.egg-info", "src/egg-info",
    "Build", "venv/lib/site-packages", "src/buildings", "docs", "a/.tox/b",
)
FILE_NAMES = (
    "mod_{k}.py", "readme_{k}.md", ".py", "__init__.py", "data_{k}.PY", "build", "x.y_{k}.py",
)


# Paths for the test-file flag and labels for the repository-URL filter.
TEST_PATHS = (
    "tests/a_{k}.py", "src/tests/x_{k}.py", "test/x_{k}.py", "src/test_{k}.py",
    "src/mod_{k}_test.py", "mytests/a_{k}.py", "src\\tests\\a_{k}.py", "src/testing_{k}.py",
    "test_dir/x_{k}.py", "tests_{k}.py", "a/tests.py/b_{k}.py",
)
SOURCE_LABELS = (
    "https://github.com/owner/repo_{k}", "https://github.com/owner/repo_{k}.git",
    "  https://github.com/o.w-n/r.e-p_{k}/ ", "git@github.com:owner/repo_{k}.git",
    "git@github.com:owner/repo_{k}", "http://github.com/owner/repo_{k}",
    "https://example.org/owner/repo_{k}", "https://github.com/owner_{k}",
    "https://github.com/owner/repo_{k}/tree", "\thttps://github.com/owner/repo_{k}.git/\n",
    "./local/folder_{k}", "https://github.com/größe/répo_{k}",
    "https://github.com/owner/re\u0301po_{k}", "https://github.com/owner²/repo_{k}",
)
RAW_SEVERITIES = ("CRITICAL", "High", "medium", "LOW", "wat", None, "")


def _pick(values: tuple, key: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def _keyed(values: tuple[str, ...]) -> Column:
    return F.replace(_pick(values, _key()), F.lit("{k}"), _key().cast("string"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys only.  A small table comes as one row group, which one task would turn into all the
    texts; spreading two numbers per row is cheap."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return orders.repartition("o_orderkey")


def listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw listing (repo_id, path, size_bytes) with files that must be skipped."""
    return _orders(spark, sf_dir).select(
        _repo(40).alias("repo_id"),
        F.concat(_pick(DIRECTORIES, _key()), F.lit("/"), _keyed(FILE_NAMES)).alias("path"),
        (_key() * 7919 % 4_000_001).alias("size_bytes"),
    )


def labelled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(_keyed(TEST_PATHS).alias("path"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository labels derived from the orders, and the addresses of the crawled pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("label"))
    return _orders(spark, sf_dir).select(_keyed(SOURCE_LABELS).alias("label")).unionByName(pages)


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with every mix of severity and confidence, one per event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    key = F.col("event_id")
    return events.select(
        "event_id",
        F.concat(F.lit("repo_"), (F.col("user_id") % 40).cast("string")).alias("repo_id"),
        _pick(("critical", "high", "medium", "low"), key).alias("severity"),
        _pick(("high", "medium", "low"), key).alias("confidence"),
        _pick(RAW_SEVERITIES, key).alias("raw_severity"),
    )


# Verdicts and planted weaknesses by file shape: (shape, line, rule).
JUDGED = ((0, 3, "sql_injection"), (4, 4, "insecure_deserialization"), (5, 4, "weak_crypto"),
          (9, 4, "command_injection_taint"))
VERDICTS = ("false_positive", "nuanced", "true_positive")
# (shape, category, rule expected to see it).  Shapes 8 and 10 are safe variants of 7 and 9.
PLANTED = (
    (0, "sql", "sql_injection"), (1, "shell", "command_injection"),
    (2, "shell", "command_injection"), (3, "secret", "hardcoded_secrets"),
    (4, "deserialization", "insecure_deserialization"), (5, "crypto", "weak_crypto"),
    (6, "eval", "eval_exec_misuse"), (7, "path", "path_traversal"),
    (8, "path", "path_traversal"), (9, "taint", "command_injection_taint"),
    (10, "taint", "command_injection_taint"),
)


def _by_shape(spark: SparkSession, sf_dir: str, entries: tuple, fields: str) -> DataFrame:
    """Orders with the entry of their shape; the entries are a fixed handful of rows."""
    table = F.array(*[
        F.struct(*[F.lit(v).alias(name) for name, v in zip(fields.split(), entry)])
        for entry in entries
    ])
    mine = F.filter(table, lambda e: e["shape"] == _key() % 16)
    return _orders(spark, sf_dir).withColumn("entry", F.explode(mine))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_shape(spark, sf_dir, JUDGED, "shape line rule_id")
    return rows.select(
        _repo(40).alias("repo_id"), _path().alias("path"), "entry.line", "entry.rule_id",
        _pick(VERDICTS, F.floor(_key() / 16)).alias("verdict"),
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_shape(spark, sf_dir, PLANTED, "shape category expected_rule_id")
    return rows.select(_repo(40).alias("repo_id"), _path().alias("path"), "entry.category",
                       "entry.expected_rule_id")
