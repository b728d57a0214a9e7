"""A session without ``spark.checkpoint.dir``: queries run, and only a cluster master asks for the setting."""

import os
import subprocess
import sys
import tempfile
from types import SimpleNamespace

import pytest

from orderflow import session

CODE = """
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
q = e.queries()
assert q["n_riders"](spark, "/root/testdata/sf0.001").count() == 1
assert spark.sparkContext.getCheckpointDir() is None
from orderflow import session
path = session.scratch_path(spark, "x")
spark.range(3).write.parquet(path)
session.clear_scratch(spark)
import os
assert not os.path.exists(path)
print("fine")
"""


def test_session_without_checkpoint_setting():
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(prefix="orderflow-conf-"),
                        "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_cluster_master_without_setting_names_it():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake)
