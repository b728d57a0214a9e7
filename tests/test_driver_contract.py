"""The driver imports the entry module from outside the repository."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() == 1
qs = E.queries()
print("gate", qs["gate_stream"](spark, "/root/testdata/sf0.001").count())
print("kde", qs["price_density"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_workers_import_package_from_any_cwd():
    cwd = tempfile.mkdtemp(prefix="orderflow-cwd-")
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=600,
                       env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert r.returncode == 0, r.stderr[-3000:]
    assert "kde 500" in r.stdout and "gate " in r.stdout
