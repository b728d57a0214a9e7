"""Run a streaming query to completion (``availableNow``) and read its result.

Sinks and checkpoints live below ``spark.checkpoint.dir`` (a shared folder on
a cluster), so a query restarted after a driver or executor loss resumes
from its checkpoint and never re-emits committed batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow import schemas
from orderflow.session import list_folder, scratch_path


def events_stream(spark: SparkSession, base: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table, one file or a folder of files, as a file stream, with ``ts`` as a watermarkable timestamp."""
    r = spark.readStream.schema(schemas.EVENTS)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    # a stream takes a single file by a pattern only
    return r.parquet(f"{base}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, path: str, schema: T.StructType, ts_cols: tuple[str, ...] = (),
                 max_files: int | None = None) -> DataFrame:
    """A parquet folder as a file stream; NTZ columns in ``ts_cols`` become ``timestamp``."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    df = r.parquet(path)
    for c in ts_cols:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def run_available_now(stream: DataFrame, name: str, *, mode: str = "append",
                      checkpoint: str | None = None, out: str | None = None,
                      foreach_batch=None, keys: list[str] | None = None) -> DataFrame:
    """Process everything available, stop, and return the sink's content.

    * ``append``: parquet file sink (exactly-once through its metadata log).
    * ``complete``: every micro-batch carries the full result; it is written
      to ``<out>/epoch=<id>`` (re-running an epoch overwrites the same
      folder) and the last epoch is returned.
    * ``update`` (with ``keys``): each micro-batch carries only the groups
      it changed; they are appended to a changelog (``changelog_batch``)
      and the newest row per key is returned.  With a watermark the state
      store drops finished groups, so neither state nor sink writes grow
      with the whole result.
    * ``foreach_batch``: a custom ``(df, epoch_id, out)`` writer; the
      content of ``out`` is returned.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)
    checkpoint = checkpoint or out + "-checkpoint"
    schema = stream.schema
    if foreach_batch is not None:
        q = (stream.writeStream.foreachBatch(lambda df, eid: foreach_batch(df, eid, out))
             .outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return _read_or_empty(spark, out, None)
    if mode == "update":
        from orderflow.streaming.sinks import changelog_batch, read_latest
        if not keys:
            raise ValueError("update mode needs the key columns of the aggregate")
        q = (stream.writeStream.foreachBatch(lambda df, eid: changelog_batch(df, eid, out, keys)).outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        # the sink is read as it stands: a restart without new input returns what earlier runs wrote
        if not list_folder(spark, out):
            return spark.createDataFrame([], schema)
        return read_latest(spark, out, keys).select(*schema.names)
    if mode == "append":
        q = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return _read_or_empty(spark, out, schema)

    def write_epoch(df: DataFrame, epoch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    q = (stream.writeStream.foreachBatch(write_epoch).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    epochs = [int(n.partition("=")[2]) for n in list_folder(spark, out) or [] if n.startswith("epoch=")]
    if not epochs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/epoch={max(epochs)}")


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """The sink's content; empty if nothing was ever written there. A failed read is raised."""
    if not list_folder(spark, path):
        return spark.createDataFrame([], schema or T.StructType([]))
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
