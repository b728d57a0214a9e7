"""Streaming: multi-batch results, restart from checkpoint without duplicates."""

import os

from pyspark.sql import functions as F

from orderflow import schemas
from orderflow.operators import legacy
from orderflow.plans import catalog, feeds
from orderflow.session import scratch_path
from orderflow.sources import messages
from orderflow.streaming import run_available_now, table_stream
from orderflow.streaming.sinks import append_batch
from tests.conftest import SF_SMALL


def test_append_restart_does_not_duplicate(spark):
    f = catalog.fx(spark, SF_SMALL)
    feed = scratch_path(spark, "feed")
    msgs = feeds.confirmed_messages(f)
    msgs.filter(F.col("value").contains('"size":"F"')).select("value").write.text(feed + "/part1")
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")

    def run():
        s = messages.read_feed(spark, fmt="text", path=feed + "/*", max_per_trigger=1)
        return run_available_now(messages.parse_confirmed(s), "x", out=out, checkpoint=ckpt,
                                 foreach_batch=append_batch)

    first = run().count()
    again = run().count()                       # nothing new: same content
    assert first == again > 0
    msgs.filter(~F.col("value").contains('"size":"F"')).select("value").write.text(feed + "/part2")
    total = run()
    assert total.count() == f.legacy_orders.count()
    assert total.select("id").distinct().count() == total.count()


def test_running_totals_over_several_batches(spark):
    f = catalog.fx(spark, SF_SMALL)
    feed = scratch_path(spark, "feed")
    feeds.confirmed_messages(f).select("value").repartition(5).write.text(feed)
    assert len([p for p in os.listdir(feed) if p.endswith(".txt")]) == 5
    s = messages.parse_confirmed(messages.read_feed(spark, fmt="text", path=feed, max_per_trigger=1))
    got = run_available_now(legacy.legacy_totals(s), "totals", mode="complete").first()
    want = legacy.legacy_totals(f.legacy_orders).first()
    assert got == want


def test_windowed_slots_stream(spark):
    f = catalog.fx(spark, SF_SMALL)
    path = scratch_path(spark, "log")
    f.orders_status.repartition(3).write.parquet(path)
    s = table_stream(spark, path, schemas.ORDERS_STATUS, ts_cols=("event_timestamp",), max_files=1)
    agg = (s.withWatermark("event_timestamp", "1 day").groupBy(F.window("event_timestamp", "15 minutes"))
           .agg(F.count(F.lit(1)).alias("n")))
    out = run_available_now(agg, "slots", mode="complete")
    assert out.agg(F.sum("n")).first()[0] == f.orders_status.count()


def test_update_mode_changelog_restart(spark):
    """Keyed update-mode aggregate: restart with new files updates only changed groups."""
    f = catalog.fx(spark, SF_SMALL)
    log = f.orders_status
    path = scratch_path(spark, "log")
    log.filter(F.col("order_id") % 2 == 0).write.parquet(path + "/a")
    out, ckpt = scratch_path(spark, "daily"), scratch_path(spark, "ckpt")

    def run():
        s = table_stream(spark, path + "/*", schemas.ORDERS_STATUS, ts_cols=("event_timestamp",), max_files=1)
        agg = s.groupBy(F.to_date("event_timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
        return run_available_now(agg, "daily", mode="update", keys=["day"], out=out, checkpoint=ckpt)

    first = {r["day"]: r["n"] for r in run().collect()}
    log.filter(F.col("order_id") % 2 == 1).write.parquet(path + "/b")
    second = {r["day"]: r["n"] for r in run().collect()}
    want = {r["day"]: r["n"] for r in log.groupBy(F.to_date("event_timestamp").alias("day"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert second == want and first != want
