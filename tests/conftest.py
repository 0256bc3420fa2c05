import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from astrolake.operators.scan import Scan
from astrolake.session import local_session
from astrolake.sources.code_files import code_files


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def file_table(spark, rows):
    """File table of (repo_id, path, text or bytes) rows."""
    raw = [
        (repo, path, bytearray(text.encode() if isinstance(text, str) else text))
        for repo, path, text in rows
    ]
    return code_files(spark.createDataFrame(raw, "repo_id string, path string, content binary"))


@pytest.fixture(scope="session")
def scan_cases(spark):
    """Scan {case: text or (path, text)}; gives {case: findings} for both kinds, in scan order."""
    def run(cases):
        rows = []
        for name, case in cases.items():
            path, text = case if isinstance(case, tuple) else ("sample_module.py", case)
            rows.append((name, path, text))
        scan = Scan.full(file_table(spark, rows))
        security = {name: [] for name in cases}
        for row in scan.security_findings().orderBy("rule_seq", "pos").collect():
            security[row.repo_id].append(row)
        quality = {name: [] for name in cases}
        for row in scan.quality_findings().orderBy("check_seq", "pos").collect():
            quality[row.repo_id].append(row)
        return security, quality

    return run
