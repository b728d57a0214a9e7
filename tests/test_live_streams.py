"""Live operators over several micro-batches: event-time gate, state tables, KPI row, late slots, live match."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow import schemas
from orderflow.operators import daily, lifecycle
from orderflow.plans import catalog
from orderflow.session import list_folder, scratch_path
from orderflow.streaming import gate_event_time, run_available_now, table_stream
from orderflow.streaming.gate import gate_into_log
from orderflow.streaming.live import kpi_row_writer, match_live, read_kpi_row, read_slots, slot_writer
from orderflow.streaming.state_table import StateTable
from tests.conftest import SF_SMALL
from tests.helpers import events_df, responses_df

T0 = dt.datetime(2024, 1, 1)
END = (None, None, None, None, "2030-01-01 00:00:00")


def at(minutes):
    return (T0 + dt.timedelta(minutes=minutes)).isoformat(sep=" ")


def feed_of(spark, batches, make=responses_df):
    """One file a batch, in this order."""
    path = scratch_path(spark, "feed")
    for rows in batches:
        make(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return path


def responses_feed(spark, path):
    return table_stream(spark, path, schemas.RIDER_RESPONSE, ts_cols=("event_timestamp",), max_files=1)


def some_responses(seed, n=240, orders=14):
    r = random.Random(seed)
    return [(i, r.randint(0, orders), r.choice([1, 2, 3, 4, None]), r.choice(["accepted"] + ["denied"] * 6), at(r.randint(0, 600)))
            for i in range(n)]


def gate(spark, path, delay, **params):
    out, ckpt = scratch_path(spark, "gate"), scratch_path(spark, "gate-ckpt")
    got = run_available_now(gate_event_time(responses_feed(spark, path), 3, delay=delay, groups=3, **params), "gate",
                            out=out, checkpoint=ckpt)
    return sorted(x.response_id for x in got.collect()), ckpt


@pytest.mark.parametrize("seed", [1, 2])
def test_event_time_gate_of_a_shuffled_feed_equals_the_batch_gate(spark, seed):
    rows = some_responses(seed)
    path = feed_of(spark, [rows[k::5] for k in range(5)] + [[END]])
    got, ckpt = gate(spark, path, "11 hours")
    want = sorted(x.response_id for x in lifecycle.admit_responses(responses_df(spark, rows), 3).collect())
    assert got == want and len(want) < len(rows)
    assert spark.read.format("statestore").load(ckpt).count() == 0  # every order is evicted


def test_event_time_gate_with_a_log_equals_the_batch_gate(spark):
    rows = some_responses(5)
    log = [(0, "accepted", 1, at(0)), (1, "denied", 1, at(0)), (1, "denied", 2, at(0)), (2, "denied", 1, at(0)),
           (2, "denied", 2, at(0)), (2, "denied", 4, at(0)), (3, "pending", None, at(0)), (3, "denied", 1, at(0)),
           (3, "denied", 1, at(1)), (99, "accepted", 1, at(0))]
    lg = events_df(spark, log)
    got, _ = gate(spark, feed_of(spark, [rows[k::4] for k in range(4)] + [[END]]), "11 hours", log=lg)
    assert got == sorted(x.response_id for x in lifecycle.admit_responses(responses_df(spark, rows), 3, log=lg).collect())


def test_event_time_gate_releases_behind_the_watermark_and_drops_late_rows(spark):
    rows = [(1, 7, 1, "denied", at(0)), (2, 7, 2, "denied", at(100)), (3, 7, 3, "accepted", at(90)), (4, 8, 1, "denied", at(300)),
            (5, 7, 4, "accepted", at(10))]  # the last one comes when the watermark has passed it
    path = feed_of(spark, [[r] for r in rows])
    got, ckpt = gate(spark, path, "60 minutes")
    # 2 is later than the acceptance; 4 still waits: the watermark is an hour behind it
    assert got == [1, 3]
    held = spark.read.format("statestore").load(ckpt)
    assert held.count() == 2  # a closed order within its horizon, and an order that waits
    assert sum(len(r.value[0] or []) if not hasattr(r.value, "groupState") else len(r.value.groupState.h_id or [])
               for r in held.collect()) == 1


def test_quiet_and_closed_orders_are_evicted_after_the_horizon(spark):
    path = feed_of(spark, [[(1, 7, 1, "denied", at(0))], [(2, 8, 1, "accepted", at(1))], [(3, 9, 1, "denied", at(400))], [END]])
    got, ckpt = gate(spark, path, "10 minutes", horizon_seconds=60)
    assert got == [1, 2, 3] and spark.read.format("statestore").load(ckpt).count() == 0


# ---- state tables


def test_state_table_versions_replay_and_compaction(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    state = StateTable(scratch_path(spark, "state"), "k", schema, buckets=4)
    want = {}
    for epoch in range(6):
        rows = [(k, epoch * 100 + k) for k in range(epoch, epoch + 3)]
        df = spark.createDataFrame(rows, schema)
        for attempt in range(2):  # every epoch runs twice, as after a failure
            touched = state.touched(df)
            before = state.read(spark, epoch, touched)
            state.write(before.join(df, "k", "left_anti").unionByName(df), epoch, touched)
            state.compact(spark, epoch)
        want |= dict(rows)
        assert {r.k: r.v for r in state.read(spark, epoch + 1).collect()} == want
    assert all(len(v) <= 2 for v in state.versions(spark, 6).values())  # the newest, and what the last epoch read


def test_state_of_an_unfinished_epoch_does_not_count(spark):
    schema = T.StructType([T.StructField("k", T.LongType())])
    state = StateTable(scratch_path(spark, "state"), "k", schema, buckets=2)
    state.write(spark.range(3).toDF("k"), 0, [0, 1])
    # an epoch that was stopped before its job committed
    spark.createDataFrame([(9, 0)], "k long, bucket int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .partitionBy("bucket").parquet(f"{state.path}/epoch=1")
    assert sorted(r.k for r in state.read(spark, 5).collect()) == [0, 1, 2]
    assert state.read(spark, 0).count() == 0


def test_gate_log_reads_closing_state_and_not_the_log(spark):
    rows = sorted(some_responses(9, 200, 40), key=lambda r: r[4])
    rows = [r for r in rows if r[2] is not None]
    path = feed_of(spark, [rows[40 * k:40 * (k + 1)] for k in range(5)])
    out = scratch_path(spark, "log")
    got = run_available_now(responses_feed(spark, path), "g", out=out, foreach_batch=gate_into_log(out, 3, buckets=4))
    want = lifecycle.admit_responses(responses_df(spark, rows), 3)
    assert sorted(r.response_id for r in got.collect()) == sorted(r.response_id for r in want.collect())
    state = StateTable(out + "-state", "order_id", spark.read.parquet(out).select("order_id", "rider_id", "status").schema, 4)
    kept = state.read(spark, 99)
    assert kept.count() == want.select("order_id", "rider_id", "status").distinct().count()
    assert all(len(v) <= 2 for v in state.versions(spark, 99).values())


# ---- the live KPI row


def test_kpi_row_equals_the_batch_row_after_every_epoch(spark):
    f = catalog.fx(spark, SF_SMALL)
    log = f.orders_status.where((F.col("order_id") % 5 == 0)).cache()
    path = scratch_path(spark, "log")
    for k in range(4):
        log.where(F.pmod(F.xxhash64("order_id", "status", "rider_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(path)
    out = scratch_path(spark, "kpi")
    batches = []
    writer = kpi_row_writer(out, f.orders, catalog.AS_OF, catalog.N, buckets=3)

    def write(df, epoch, to):
        batches.append([tuple(r) for r in df.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz")).collect()])
        writer(df, epoch, to)
        writer(df, epoch, to)  # a replay changes nothing
        so_far = spark.createDataFrame([r for b in batches for r in b], schemas.ORDERS_STATUS)
        first = (so_far.where("status = 'pending'").join(f.orders.select("order_id", "user_id"), "order_id")
                 .groupBy("user_id").agg(F.to_date(F.min("event_timestamp")).alias("registration_date")))
        want = daily.daily_kpis(so_far, f.orders, first, catalog.AS_OF, catalog.N).first()
        assert tuple(read_kpi_row(spark, out).first()) == tuple(want)

    s = table_stream(spark, path, schemas.ORDERS_STATUS, ts_cols=("event_timestamp",), max_files=1)
    run_available_now(s, "kpi", out=out, foreach_batch=write)
    assert len(batches) == 4 and read_kpi_row(spark, out).first().total_orders > 10


def test_kpi_row_of_no_events(spark):
    assert tuple(read_kpi_row(spark, scratch_path(spark, "none")).first()) == (0, 0, None, 0, None, "No orders yet")


def test_an_acceptance_takes_its_order_out_of_the_active_ones(spark):
    day = catalog.AS_OF.isoformat()
    orders = spark.createDataFrame([(1, 5, "9.50"), (2, 5, "1.00")], "order_id long, user_id long, total_amount string") \
        .withColumn("total_amount", F.col("total_amount").cast("decimal(10,2)"))
    out = scratch_path(spark, "kpi")
    write = kpi_row_writer(out, orders, catalog.AS_OF)
    seen = []
    for epoch, rows in enumerate([[(1, "pending", None, f"{day} 10:00:00"), (2, "pending", None, f"{day} 11:00:00")],
                                  [(1, "accepted", 3, f"{day} 10:05:00")],
                                  [(2, "pending", None, "1990-01-01 00:00:00")]]):  # user 5 was there long before
        write(events_df(spark, rows), epoch, out)
        seen.append(tuple(read_kpi_row(spark, out).first())[:4])
    from decimal import Decimal
    assert seen == [(2, 2, Decimal("10.50"), 1), (2, 1, Decimal("10.50"), 1), (2, 1, Decimal("10.50"), 0)]


# ---- late rows of slots


def test_slots_and_late_rows_add_up(spark):
    batches = [[(1, "pending", None, at(0)), (2, "pending", None, at(16))], [(3, "pending", None, at(200))],
               [(4, "pending", None, at(1)), (5, "pending", None, at(170)), (6, "pending", None, at(201))]]
    path = feed_of(spark, batches, events_df)
    out = scratch_path(spark, "slots")
    s = table_stream(spark, path, schemas.ORDERS_STATUS, ts_cols=("event_timestamp",), max_files=1)
    run_available_now(s, "slots", out=out, foreach_batch=slot_writer(out, delay_seconds=3600, buckets=2))
    got = {r.window_start.strftime("%H:%M"): (r.num_orders, r.late_orders) for r in read_slots(spark, out).collect()}
    # 4 comes with the watermark at 02:20; 5 is late, too, but within the delay
    assert got == {"00:00": (1, 1), "00:15": (1, 0), "02:45": (1, 0), "03:15": (2, 0)}
    assert "epoch=0" in list_folder(spark, out + "-mark")


# ---- two live feeds


def test_live_match_and_its_late_rows(spark):
    offers = [[(1, at(0)), (2, at(5))], [(3, at(300))], [(4, at(600))], [(5, at(2))]]
    answers = [[(1, 1, "accepted", at(3)), (2, 9, "denied", at(6))], [(3, 2, "denied", at(320)), (2, 1, "denied", at(7))],
               [(4, 1, "accepted", at(601))], [(5, 1, "accepted", at(3)), (1, 2, "denied", at(1))]]
    ts = F.col("t").cast("timestamp_ntz")
    make = lambda cols: lambda sp, rows: sp.createDataFrame(rows, f"{cols}, t string").withColumn("t", ts)
    p, q = feed_of(spark, offers, make("order_id long")), feed_of(spark, answers, make("order_id long, rider_id int, status string"))
    o = table_stream(spark, p, spark.read.parquet(p).schema, ("t",), 1).withColumnRenamed("t", "offered_at")
    r = table_stream(spark, q, spark.read.parquet(q).schema, ("t",), 1).withColumnRenamed("t", "answered_at")
    riders = spark.createDataFrame([(1,), (2,), (2,)], "rider_id int")
    ckpt = scratch_path(spark, "match-ckpt")
    got = run_available_now(match_live(o, r, riders, within="10 MINUTES", delay="1 hour"), "match", checkpoint=ckpt)
    # 3 is answered after 20 minutes; rider 9 is unknown; offers and answers behind the watermark are dropped
    assert sorted((x.order_id, x.rider_id) for x in got.collect()) == [(1, 1), (2, 1), (4, 1)]
    left = spark.read.format("statestore").option("joinSide", "left").load(ckpt).count()
    assert left <= 2  # offers that no answer can reach have left the state
