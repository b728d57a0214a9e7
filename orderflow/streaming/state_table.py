"""Keyed state kept in a table: bucketed snapshots, one per epoch that touches a bucket.

``foreachBatch`` operators whose state must outlive a query, be read by other
jobs or be exact for any order of arrival keep it here instead of the state
store. Rows are dealt into ``buckets`` by a hash of the key. An epoch reads
only the buckets that its rows touch, in their newest version below the epoch,
and writes those buckets anew, so what it reads depends on the keys in them
and not on how many epochs there were.

Layout: ``<path>/epoch=<n>/bucket=<b>/part-*``. An epoch's folder is written by
one job and counts once that job has committed (``_SUCCESS``). A replayed epoch
reads the same versions as the first time and overwrites its own folder.
``compact`` drops versions that no replay can ask for: those below the newest
one under the epoch at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.session import delete_folder, list_folder


@dataclass(frozen=True)
class StateTable:
    path: str
    key: str
    schema: T.StructType
    buckets: int = 32

    def bucket_of(self, df: DataFrame) -> DataFrame:
        """``df`` with the bucket of its key."""
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``df``: at most ``buckets`` numbers."""
        return sorted(r.bucket for r in self.bucket_of(df.select(self.key)).select("bucket").distinct().collect())

    def versions(self, spark: SparkSession, below: int) -> dict[int, list[int]]:
        """The committed epochs under ``below`` of every bucket, newest first."""
        found: dict[int, list[int]] = {}
        epochs = sorted((int(n.partition("=")[2]) for n in list_folder(spark, self.path) or [] if n.startswith("epoch=")),
                        reverse=True)
        for epoch in (e for e in epochs if e < below):
            names = list_folder(spark, f"{self.path}/epoch={epoch}") or []
            if "_SUCCESS" in names:
                for n in names:
                    if n.startswith("bucket="):
                        found.setdefault(int(n.partition("=")[2]), []).append(epoch)
        return found

    def read(self, spark: SparkSession, below: int, buckets: list[int] | None = None) -> DataFrame:
        """The state as the epochs under ``below`` left it, of some buckets or all."""
        newest = {b: v[0] for b, v in self.versions(spark, below).items() if buckets is None or b in buckets}
        paths = [f"{self.path}/epoch={e}/bucket={b}" for b, e in sorted(newest.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def write(self, state: DataFrame, epoch: int, buckets: list[int]) -> None:
        """The new state of the buckets, which must hold all their rows, and one file a bucket."""
        (self.bucket_of(state.select(*self.schema.names)).repartition(max(1, len(buckets)), "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}"))

    def compact(self, spark: SparkSession, epoch: int) -> None:
        """Drop the versions that a replay of ``epoch`` or a later one does not read."""
        for bucket, epochs in self.versions(spark, epoch).items():
            for old in epochs[1:]:
                delete_folder(spark, f"{self.path}/epoch={old}/bucket={bucket}")
