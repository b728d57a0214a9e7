"""Session construction and the shared scratch/checkpoint location.

On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
every table this library materialises (stream sinks, stream checkpoints,
lineage cuts) lives under it.  The setting is only read, never written: Spark
refuses to change it on a running session.  Without it, an in-process
``local`` master gets a private folder, and any other master gets an error at
the first operator that materialises something.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that make local runs behave like the cluster configuration:
# UTC session clock (timestamps in data are zone-less), AQE for runtime
# coalescing / skew splitting / broadcast conversion.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "orderflow") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``orderflow`` importable in the Python workers (once per context).

    The pandas-backed operators (price density partial sums, the state-store
    gate) run functions of this package inside tasks.  When the package is
    installed on the workers, or shipped with ``--py-files``, nothing is
    needed; when it is imported from a source checkout, the package folder is
    zipped and added with ``addPyFile``, which distributes it to every
    executor through Spark itself.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    _SHIPPED.add(key)
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    if ".zip" in pkg_dir or "site-packages" in pkg_dir:
        return  # already a distributed archive or an installed package
    root = os.path.dirname(pkg_dir)
    worker_path = [os.getcwd()] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.master.startswith("local") and any(os.path.abspath(p) == root for p in worker_path):
        return  # local workers start in this folder / with this path and import it directly
    import zipfile
    out_dir = tempfile.mkdtemp(prefix="orderflow-pyfiles-")  # driver-side; Spark serves it to executors
    zpath = os.path.join(out_dir, "orderflow.zip")
    root = os.path.dirname(pkg_dir)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(base, fn)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)


_LOCAL_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``.

    Unset on a ``local[...]`` master: a private folder, one per application.
    Unset anywhere else: a ``RuntimeError`` that names the setting, since a
    folder of the driver's machine would be invisible to the executors.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; "
                               "this operator writes intermediate tables there")
        root = _LOCAL_ROOT.get(sc.applicationId)
        if root is None:
            root = _LOCAL_ROOT[sc.applicationId] = tempfile.mkdtemp(prefix="orderflow-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the checkpoint root."""
    return os.path.join(checkpoint_root(spark), "orderflow", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the application's scratch folder for one materialisation."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def list_folder(spark: SparkSession, path: str) -> list[str] | None:
    """Names in ``path`` on any Hadoop file system; ``None`` if it does not exist. Other failures are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return [s.getPath().getName() for s in fs.listStatus(p)]


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all below it on any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application has materialised with ``scratch_path``.

    Frames that read those folders must not be used afterwards.  Works on
    any Hadoop file system.
    """
    delete_folder(spark, scratch_root(spark))
