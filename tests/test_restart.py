"""Streaming sinks after a restart: the same content with nothing new, the merged content with new files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderflow.session import scratch_path
from orderflow.streaming import run_available_now, table_stream
from orderflow.streaming.runner import _read_or_empty
from orderflow.streaming.sinks import append_batch
from tests.helpers import events_df, rows

from orderflow import schemas


def _write(spark, path, first, n):
    data = [(first + k, "pending", None, f"2024-03-0{1 + k % 3} 10:00:00") for k in range(n)]
    events_df(spark, data).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("mode", ["update", "complete", "foreach"])
def test_restart_with_nothing_new_and_with_new_files(spark, mode):
    feed, out, ckpt = (scratch_path(spark, f"restart-{x}") for x in ("feed", "out", "ckpt"))
    _write(spark, feed, 0, 7)

    def run():
        s = table_stream(spark, feed, schemas.ORDERS_STATUS, ts_cols=("event_timestamp",), max_files=1)
        if mode == "foreach":
            got = run_available_now(s.select("order_id"), "r", out=out, checkpoint=ckpt, foreach_batch=append_batch)
            return sorted(r.order_id for r in got.collect())
        daily = s.groupBy(F.to_date("event_timestamp").alias("day")).agg(F.count("*").alias("n"))
        got = run_available_now(daily, "r", mode=mode, keys=["day"], out=out, checkpoint=ckpt)
        return rows(got, "day", "n")

    first = run()
    assert first == run() and first
    _write(spark, feed, 100, 5)
    second = run()
    assert second == run() and second != first
    if mode != "foreach":
        assert second == [(dt.date(2024, 3, 1), 5), (dt.date(2024, 3, 2), 4), (dt.date(2024, 3, 3), 3)]


def test_a_failed_read_is_raised(spark):
    path = scratch_path(spark, "broken")
    spark.range(3).write.parquet(path)
    name = next(f for f in spark.read.parquet(path).inputFiles())
    with open(name.removeprefix("file://").replace("file:", ""), "wb") as f:
        f.write(b"not parquet at all")
    with pytest.raises(Exception):
        _read_or_empty(spark, path, spark.range(3).schema).collect()


def test_no_query_is_left_out_silently():
    from orderflow.plans import catalog
    catalog.load_all()
    assert {"stream_slots", "gate_stream", "append_menu", "category_share"} <= set(catalog.REGISTRY)
