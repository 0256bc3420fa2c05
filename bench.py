"""Benchmark of the headline queries.  Prints one JSON line.

Every query runs from source text to result; nothing is shared between them.  One small run before
the clock starts brings up the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from astrolake.operators.nodes import syntax_nodes  # noqa: E402
from astrolake.plans.queries import REGISTRY  # noqa: E402
from astrolake.session import local_session  # noqa: E402
from astrolake.sources.order_corpus import corpus  # noqa: E402

HEADLINE = (
    "corpus_scan", "parse_nodes", "parse_summary", "calls_view",
    "rule_sql_injection", "rule_command_injection", "rule_hardcoded_secrets",
    "rule_deserialization", "rule_weak_crypto", "rule_input_validation", "rule_path_traversal",
    "rule_eval_exec", "rule_taint", "complexity_metric", "unused_vars", "dead_after_terminal",
    "all_security_findings", "all_quality_findings", "risk_label", "findings_by_tier",
    "top_findings", "scan_dashboard", "secret_text_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        run("parse_nodes", small)
    times = {}
    for name in chosen:
        times[name] = run(name, sf_dir)
        print(f"{name}: {times[name]}", file=sys.stderr)
    files = corpus(spark, sf_dir)
    n_files = files.count()
    start = time.perf_counter()
    n_nodes = syntax_nodes(files).agg(F.count("*")).first()[0]
    parse_seconds = time.perf_counter() - start
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "files": n_files,
        "parse_files_per_sec": round(n_files / parse_seconds),
        "parse_nodes_per_sec": round(n_nodes / parse_seconds),
        "state": "warm workers, cold data",
    }))


if __name__ == "__main__":
    main()
