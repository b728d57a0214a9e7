"""The entry module keeps the order-flow queries when something that the training-data queries need is missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), sum(n.startswith("op") and n[2].isdigit() for n in e.queries()), "pipeline" in e.queries(), len(e.oracle_sql()))
"""


def run(gone):
    r = subprocess.run([sys.executable, "-c", BLOCK.format(gone=gone)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]
    return r.stdout.split(), r.stderr


def test_a_missing_dependency_is_told_and_leaves_the_other_queries():
    (n, ops, pipeline, oracles), said = run("zstandard")
    if os.path.isdir(os.path.join(ROOT, "orderflow", "llm")):
        assert "zstandard" in said and "RuntimeWarning" in said
    assert int(n) >= 82 and ops == "0" and pipeline == "False" and int(oracles) >= 80


def test_a_missing_subpackage_is_no_warning():
    (n, ops, pipeline, _), said = run("orderflow.llm")
    assert int(n) >= 82 and ops == "0" and pipeline == "False" and "RuntimeWarning" not in said
