"""Where a consumer of a feed starts (A10), and the progress that it commits.

A consumer has a name and one folder of progress, which outlives the query: a
checkpoint (the files or offsets that it has consumed) and a ``position``, the
start that its first run decided on. A later run, on any driver, goes on from
what is committed, whatever start it asks for; two consumers do not see each
other's progress. The start counts only for a consumer without progress:

* ``earliest``: everything that the feed holds;
* ``latest``: only what arrives after the first run;
* a ``datetime`` (without zone: UTC): what was appended at or after it. A Kafka feed goes by the records' append times, a file feed by
  the files' modification times.

``latest`` on a file feed is not a clock: a first run that lets no row through marks
all files that are there as consumed, and leaves the query's state empty. If it
fails before ``position`` is written, the next run marks again. Spark's file source passes
over files older than the newest by ``maxFileAge`` (a week), except in a consumer's first batch.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import delete_folder, list_folder

Start = str | dt.datetime


def _millis(at: dt.datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=dt.UTC)
    return (at - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)


def _checked(start: Start) -> Start:
    if not isinstance(start, dt.datetime) and start not in ("earliest", "latest"):
        raise ValueError(f"start must be 'earliest', 'latest' or a datetime, not {start!r}")
    return start


def kafka_start(start: Start) -> dict[str, str]:
    """The Kafka source's options of a start; after the last record of a partition, its end."""
    if isinstance(_checked(start), dt.datetime):
        return {"startingTimestamp": str(_millis(start)), "startingOffsetsByTimestampStrategy": "latest"}
    return {"startingOffsets": start}


@dataclass(frozen=True)
class Consumer:
    name: str
    root: str  #: a folder that all drivers share

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.name}"

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def position(self, spark: SparkSession) -> dict | None:
        """What the first run decided on; None before."""
        names = list_folder(spark, f"{self.folder}/position") or []
        if "_SUCCESS" not in names:
            return None
        return json.loads(spark.read.text(f"{self.folder}/position").first().value)

    def reset(self, spark: SparkSession) -> None:
        """Forget the progress: the next run starts anew."""
        delete_folder(spark, self.folder)

    def consume(self, open_feed: Callable[[], DataFrame], start: Start, write: Callable[[DataFrame, int], None],
                transform: Callable[[DataFrame], DataFrame] = lambda feed: feed, mode: str = "append") -> None:
        """Consume all that a file feed holds beyond the committed progress with ``write(batch, epoch)``, which must overwrite its epoch.

        ``open_feed()`` opens the feed, ``transform`` is the query on it, with state or without, and ``mode`` its output mode. An epoch
        counts once its ``write`` has returned; one that failed is replayed with the same files and the same number.
        """
        spark = open_feed().sparkSession
        at = self.position(spark)
        if at is None:
            if _checked(start) == "latest":
                delete_folder(spark, self.checkpoint)  # of a first run that failed
                self._run(transform(open_feed().where(F.lit(False))),
                          lambda batch, epoch: batch.write.format("noop").mode("overwrite").save(), mode)
            at = {"since": _millis(start) if isinstance(start, dt.datetime) else None}
            (spark.createDataFrame([(json.dumps(at),)], "value string").coalesce(1)
             .write.mode("overwrite").text(f"{self.folder}/position"))
        feed = open_feed()
        if at["since"] is not None:
            feed = feed.where(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(at["since"])))
        self._run(transform(feed), write, mode)

    def _run(self, stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str) -> None:
        (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", self.checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
