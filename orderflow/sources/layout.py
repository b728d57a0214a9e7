"""Storage layout for the large tables (R14 and co-located joins).

* The status log is written partitioned by ``event_date``; every daily and
  yearly operator filters through ``day_slice`` / ``year_slice``, which add
  an ``event_date`` predicate when the column exists, so a day's KPIs read
  one partition folder instead of the whole log.
* ``orders`` and ``order_details`` are bucketed by ``order_id``.  The daily
  operators reduce the log to one row per order (hash-partitioned by
  ``order_id``) before joining these tables; with the bucket count equal to
  ``spark.sql.shuffle.partitions`` the planner joins bucket-to-partition and
  the fact side is not shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_event_log(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append status events partitioned by day, rows clustered by order inside a file.

    Tasks get ranges of (day, hash of the order): a task holds a few
    neighbouring days, or a part of a large one, so there are at most as many
    files as days and tasks together.
    """
    (events.withColumn("event_date", F.to_date("event_timestamp"))
     .repartitionByRange("event_date", F.xxhash64("order_id"))
     .sortWithinPartitions("event_date", "order_id", "event_timestamp")
     .write.mode(mode).partitionBy("event_date").parquet(path))


def write_bucketed(df: DataFrame, table: str, key: str = "order_id", buckets: int = 512,
                   mode: str = "overwrite") -> None:
    """Save a fact table bucketed and sorted by ``key`` in the session catalog."""
    (df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table))
