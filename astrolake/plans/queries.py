"""Registered queries: name -> (spark, table folder) -> DataFrame.

All of them read whole tables.  Files come from the order corpus; each query runs from source text
to result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.fixed_values import MAX_FILE_BYTES, SECURITY_RULES
from astrolake.functions import paths
from astrolake.functions import predicates as P
from astrolake.functions import severity as S
from astrolake.functions.secrets import secret_literals
from astrolake.operators import evaluate, function_rules, quality, report, scoring, views
from astrolake.operators.nodes import STATUS, parse_status, source_lines, syntax_nodes
from astrolake.operators.scan import Scan
from astrolake.session import settled, spread, tuned
from astrolake.sources import order_corpus as corpus
from astrolake.sources.code_files import scannable, skipped_by_size

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannable(corpus.corpus(tuned(spark), sf_dir))


def _owned(files: DataFrame, rows: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", "content_sha").join(spread(rows), "content_sha")


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, the type an outside check compares with."""
    return df.select(*[
        F.col(name).cast("bigint").alias(name) if kind == "int" else F.col(name)
        for name, kind in df.dtypes
    ])


# --- sources ----------------------------------------------------------------------------------

@query
def corpus_scan(spark, sf_dir):
    return _files(spark, sf_dir).select(
        "repo_id", "path", "size_bytes", "content_sha", "is_test"
    ).orderBy("repo_id", "path")


@query
def path_prune(spark, sf_dir):
    listed = corpus.listed_paths(spark, sf_dir)
    return listed.filter(~paths.in_excluded_directory(F.col("path"))).select("repo_id", "path")


@query
def ext_filter(spark, sf_dir):
    listed = corpus.listed_paths(spark, sf_dir)
    return listed.filter(paths.has_extension(F.col("path"))).select("repo_id", "path")


@query
def size_cap(spark, sf_dir):
    listed = corpus.listed_paths(spark, sf_dir)
    return listed.filter(paths.within_size(F.col("size_bytes"), MAX_FILE_BYTES))


@query
def size_skipped(spark, sf_dir):
    """What the size cap alone leaves out."""
    skipped = skipped_by_size(corpus.listed_paths(spark, sf_dir), MAX_FILE_BYTES)
    return skipped.select("repo_id", "path", "size_bytes", "reason")


@query
def listing_filters(spark, sf_dir):
    """All three filters together."""
    return scannable(corpus.listed_paths(spark, sf_dir), max_file_bytes=MAX_FILE_BYTES)


@query
def repo_url_filter(spark, sf_dir):
    labels = corpus.source_labels(spark, sf_dir)
    return labels.select("label", paths.is_repository_url(F.col("label")).alias("is_repo_url"))


@query
def test_file_flag(spark, sf_dir):
    listed = corpus.labelled_paths(spark, sf_dir)
    return listed.select("path", paths.is_test_path(F.col("path")).alias("is_test"))


# --- parsing ----------------------------------------------------------------------------------

@query
def parse_nodes(spark, sf_dir):
    return views.kind_counts(syntax_nodes(_files(spark, sf_dir), views.KIND_COUNTS))


def _status(files):
    return parse_status(syntax_nodes(files, STATUS))


@query
def parse_failures(spark, sf_dir):
    files = _files(spark, sf_dir)
    return report.parse_failures(files, _status(files))


@query
def parse_summary(spark, sf_dir):
    files = _files(spark, sf_dir)
    return report.parse_summary(files, _status(files))


@query
def source_text_lines(spark, sf_dir):
    files = _files(spark, sf_dir)
    return _wide(_owned(files, source_lines(files)).select("repo_id", "path", "line", "text"))


# --- views ------------------------------------------------------------------------------------

_CALLED = ("func_kind", "func_name", "recv_kind", "recv_name")


@query
def calls_view(spark, sf_dir):
    files = _files(spark, sf_dir)
    needs = views.CALLS.only(*_CALLED, "args", "kws")
    calls = views.calls(syntax_nodes(files, needs))
    return _wide(_owned(files, calls).select(
        "path", "line", "func_kind", "func_name", "recv_kind", "recv_name",
        F.size("args").alias("n_args"), F.size("kws").alias("n_kws"),
    ))


@query
def functions_view(spark, sf_dir):
    files = _files(spark, sf_dir)
    functions = views.functions(syntax_nodes(files, views.FUNCTIONS.only("ident", "params")))
    return _wide(_owned(files, functions).select(
        "path", "line", "function_name", F.array_join("params", ",").alias("params")
    ))


@query
def assigns_view(spark, sf_dir):
    files = _files(spark, sf_dir)
    assigns = views.assigns(syntax_nodes(files, views.ASSIGNS.only("targets", "value")))
    names = F.array_join(F.transform("targets", lambda t: t["ident"]), ",")
    return _wide(_owned(files, assigns).select(
        "path", "line", names.alias("targets"), F.col("value.kind").alias("value_kind")
    ))


@query
def walk_membership(spark, sf_dir):
    """Calls in the walk of each function that has any."""
    files = _files(spark, sf_dir)
    calls = views.calls(syntax_nodes(files, views.CALLS.only("fns")))
    counts = (
        calls.select("content_sha", F.explode("fns").alias("fn"))
        .groupBy("content_sha", "fn").agg(F.count("*").alias("n_calls"))
    )
    return _owned(files, counts).select("path", F.col("fn.name").alias("function_name"), "n_calls")


@query
def dynamic_strings(spark, sf_dir):
    files = _files(spark, sf_dir)
    found = views.dynamic_strings(syntax_nodes(files, views.CALLS.only("func_name", "args")))
    return _wide(_owned(files, found).select("path", "line", "func_name"))


@query
def user_input_calls(spark, sf_dir):
    files = _files(spark, sf_dir)
    needs = views.CALLS.only(*_CALLED)
    found = views.user_input_calls(syntax_nodes(files, needs))
    return _wide(_owned(files, found).select("path", "line", "func_name", "recv_name"))


@query
def shell_sinks(spark, sf_dir):
    files = _files(spark, sf_dir)
    needs = views.CALLS.only(*_CALLED, "kws")
    found = views.calls(syntax_nodes(files, needs)).filter(P.is_shell_sink())
    return _wide(_owned(files, found).select("path", "line", "recv_name", "func_name"))


@query
def sensitive_names(spark, sf_dir):
    """Assigned names that look like credentials."""
    files = _files(spark, sf_dir)
    assigns = views.assigns(syntax_nodes(files, views.ASSIGNS.only("targets")))
    found = assigns.select("content_sha", "line", F.explode("targets.ident").alias("var"))
    found = found.filter(P.is_sensitive_name(F.col("var")))
    return _wide(_owned(files, found).select("path", "line", "var"))


@query
def function_marks(spark, sf_dir):
    """Input sources, sinks and safeguards in the walk of each function that has any."""
    files = _files(spark, sf_dir)
    marks = function_rules.function_marks(syntax_nodes(files, function_rules.FUNCTION_RULE_NEEDS))
    names = [name for name, kind in marks.dtypes if kind == "boolean"]
    flags = marks.groupBy("content_sha", "fn").agg(*[F.bool_or(n).alias(n) for n in names])
    return _owned(files, flags).select("path", F.col("fn.name").alias("function_name"), *names)


# --- security rules -----------------------------------------------------------------------------

_RULE_COLUMNS = (
    "repo_id", "path", "line", "severity", "confidence", "message", "function_name",
)
_RULE_QUERIES = {
    "sql_injection": "rule_sql_injection",
    "command_injection": "rule_command_injection",
    "hardcoded_secrets": "rule_hardcoded_secrets",
    "insecure_deserialization": "rule_deserialization",
    "weak_crypto": "rule_weak_crypto",
    "missing_input_validation": "rule_input_validation",
    "path_traversal": "rule_path_traversal",
    "eval_exec_misuse": "rule_eval_exec",
    "command_injection_taint": "rule_taint",
}


def _rule_query(rule_id: str) -> Query:
    def run(spark, sf_dir):
        return _wide(Scan(_files(spark, sf_dir)).rule(rule_id).select(*_RULE_COLUMNS))

    return run


for _rule, _name in _RULE_QUERIES.items():
    REGISTRY[_name] = _rule_query(_rule)


def _kept(scan: Scan, result: Callable[[Scan], DataFrame]) -> DataFrame:
    """The result of a scan, computed now; the scan's node table is dropped."""
    with scan:
        return settled(result(scan))


def _security(spark, sf_dir, snippets=False, repositories=40):
    files = scannable(corpus.corpus(tuned(spark), sf_dir, repositories))
    return _kept(Scan.security(files), lambda scan: scan.security_findings(snippets=snippets))


def _security_counts(spark, sf_dir, repositories=40):
    files = scannable(corpus.corpus(tuned(spark), sf_dir, repositories))
    return _kept(Scan.security(files), Scan.security_counts)


@query
def all_security_findings(spark, sf_dir):
    return _wide(_security(spark, sf_dir, snippets=True).drop("rule_seq", "pos"))


@query
def finding_snippet(spark, sf_dir):
    found = _security(spark, sf_dir, snippets=True)
    return _wide(found.select("path", "rule_id", "line", "code_snippet"))


@query
def secret_text_scan(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _wide(secret_literals(documents, "doc_id", "text"))


# --- quality checks -----------------------------------------------------------------------------

_CHECK_COLUMNS = ("repo_id", "check", "path", "line", "message", "function_name", "metric_value")


def _metrics(spark, sf_dir):
    files = _files(spark, sf_dir)
    return _owned(files, quality.function_metrics(syntax_nodes(files, quality.METRIC_NEEDS)))


@query
def complexity_metric(spark, sf_dir):
    return _wide(_metrics(spark, sf_dir).select("path", "line", "function_name", "complexity"))


@query
def nesting_metric(spark, sf_dir):
    return _wide(_metrics(spark, sf_dir).select("path", "line", "function_name", "nesting"))


def _check_query(check: str) -> Query:
    def run(spark, sf_dir):
        return _wide(Scan(_files(spark, sf_dir)).check(check).select(*_CHECK_COLUMNS))

    return run


for _check, _name in {
    "complexity": "complex_functions",
    "nesting_depth": "deep_nesting",
    "unused_vars": "unused_vars",
    "dead_code": "dead_code",
    "dead_after": "dead_after_terminal",
    "dead_branch": "dead_constant_branch",
}.items():
    REGISTRY[_name] = _check_query(_check)


def _quality(spark, sf_dir):
    return _kept(Scan.quality(_files(spark, sf_dir)), Scan.quality_findings)


@query
def all_quality_findings(spark, sf_dir):
    return _wide(_quality(spark, sf_dir).select(*_CHECK_COLUMNS))


# --- scores and report tables -------------------------------------------------------------------

@query
def effective_severity(spark, sf_dir):
    found = scoring.with_effective_severity(corpus.event_findings(spark, sf_dir))
    return found.select("event_id", "severity", "confidence", "effective_severity")


@query
def severity_normalise(spark, sf_dir):
    found = corpus.event_findings(spark, sf_dir)
    return found.select(
        "event_id", S.normalised_severity(F.col("raw_severity")).alias("severity")
    )


@query
def event_severity_breakdown(spark, sf_dir):
    return scoring.severity_breakdown(corpus.event_findings(spark, sf_dir), "repo_id")


@query
def event_risk_score(spark, sf_dir):
    return scoring.risk_score(corpus.event_findings(spark, sf_dir), "repo_id")


@query
def risk_density(spark, sf_dir):
    files = _files(spark, sf_dir)
    return _wide(scoring.risk_density(files, corpus.event_findings(spark, sf_dir), "repo_id"))


@query
def severity_breakdown(spark, sf_dir):
    return scoring.severity_breakdown(_security_counts(spark, sf_dir), "repo_id")


@query
def risk_score(spark, sf_dir):
    return scoring.risk_score(_security_counts(spark, sf_dir), "repo_id")


@query
def risk_label(spark, sf_dir):
    """Per customer, so that clean repositories and all labels occur."""
    files = scannable(corpus.corpus(tuned(spark), sf_dir, repositories=None))
    found = _kept(Scan.security(files), Scan.security_counts)
    return scoring.risk_labels(files, found, "repo_id")


@query
def findings_by_tier(spark, sf_dir):
    ranked = report.findings_by_tier(_security(spark, sf_dir))
    return _wide(ranked.select(
        "repo_id", "effective_severity", "position", "path", "line", "rule_id"
    ))


@query
def category_counts(spark, sf_dir):
    counts = report.category_counts(_security_counts(spark, sf_dir))
    return _wide(counts.select("repo_id", "rule_id", "n", "position"))


@query
def category_share(spark, sf_dir):
    counts = report.category_counts(_security_counts(spark, sf_dir))
    return counts.select("repo_id", "rule_id", "share")


@query
def quality_by_check(spark, sf_dir):
    ranked = report.quality_by_check(_quality(spark, sf_dir))
    return _wide(ranked.select("repo_id", "check", "position", "path", "line"))


@query
def check_counts(spark, sf_dir):
    counts = _kept(Scan.quality(_files(spark, sf_dir)), Scan.quality_counts)
    return report.check_counts(counts, "repo_id")


@query
def top_findings(spark, sf_dir):
    top = report.top_findings(_quality(spark, sf_dir))
    return _wide(top.select("repo_id", "position", "check", "path", "line", "message"))


@query
def message_preview(spark, sf_dir):
    found = report.message_previews(_security(spark, sf_dir))
    return _wide(found.select("path", "rule_id", "line", "preview"))


@query
def escape_text(spark, sf_dir):
    found = report.escaped(_security(spark, sf_dir, snippets=True))
    return _wide(found.select("path", "rule_id", "line", "message", "code_snippet"))


@query
def scan_dashboard(spark, sf_dir):
    return _kept(Scan.full(_files(spark, sf_dir)), Scan.dashboard)


# --- evaluation ---------------------------------------------------------------------------------

@query
def rule_coverage_gap(spark, sf_dir):
    """Rules that found nothing in a customer's files."""
    files = scannable(corpus.corpus(tuned(spark), sf_dir, repositories=None))
    expected = files.select("repo_id").distinct().select(
        "repo_id", F.explode(F.array(*map(F.lit, SECURITY_RULES))).alias("rule_id")
    )
    found = _kept(Scan.security(files), Scan.security_counts)
    return evaluate.rule_coverage_gap(expected, found)


@query
def verdict_rates(spark, sf_dir):
    return evaluate.verdict_rates(_security(spark, sf_dir), corpus.verdicts(spark, sf_dir))


@query
def verdict_conflicts(spark, sf_dir):
    """Verdict rates where a second reviewer has judged the first line of every other path anew."""
    first = corpus.verdicts(spark, sf_dir)
    again = first.where("length(path) % 2 = 0").withColumn("verdict", F.lit("nuanced"))
    return evaluate.verdict_rates(_security(spark, sf_dir), first.unionByName(again))


@query
def review_sample(spark, sf_dir):
    """Two findings of each repository and rule for a reviewer, with the size of the stratum."""
    drawn = evaluate.review_sample(_security(spark, sf_dir), 2, seed="r1")
    return _wide(drawn.select("repo_id", "rule_id", "position", "path", "line", "stratum_size"))


@query
def planted_recall(spark, sf_dir):
    return evaluate.planted_recall(corpus.planted(spark, sf_dir), _security(spark, sf_dir))
