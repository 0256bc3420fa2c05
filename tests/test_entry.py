"""The entry point without its optional part."""

import os
import subprocess
import sys

from astrolake.plans import case_queries  # noqa: F401  (registers queries)
from astrolake.plans.queries import REGISTRY

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_core_queries_remain_without_an_optional_package():
    program = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in ("xxhash", "public_tokenizers", "regex"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""
    found = subprocess.run([sys.executable, "-c", program], cwd=ROOT, capture_output=True, text=True,
                           timeout=120)
    assert found.returncode == 0, found.stderr
    assert found.stdout.split() == [str(len(REGISTRY))] * 2
    assert "left out" in found.stderr
