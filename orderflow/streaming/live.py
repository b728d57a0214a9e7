"""Live forms of the daily KPI row and of the slot series, and the match of two live feeds.

The KPI row and the slots are ``foreachBatch`` writers over ``StateTable``: an
epoch reads the state of the keys it touches, works out what its rows change,
and writes its own folders, so a replayed epoch replaces itself and an epoch's
cost follows its rows and the keys near them, not the history.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions.time import day_slice
from orderflow.schemas import N_RIDERS
from orderflow.session import list_folder
from orderflow.streaming.state_table import StateTable

COUNTS = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("status", T.StringType()),
                       T.StructField("rider_id", T.IntegerType()), T.StructField("n", T.LongType())])
FIRST_SEEN = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("first_day", T.DateType())])
TOTALS = T.StructType([T.StructField("total_orders", T.LongType()), T.StructField("active_orders", T.LongType()),
                       T.StructField("revenue", T.DecimalType(20, 2)), T.StructField("new_customers", T.LongType()),
                       T.StructField("last_order_time", T.TimestampNTZType())])


def _last_row(spark, path: str, schema: T.StructType, below: int):
    """The only row of the newest committed ``<path>/epoch=<n>`` under ``below``, None if there is none."""
    epochs = [int(n.partition("=")[2]) for n in list_folder(spark, path) or [] if n.startswith("epoch=")]
    for epoch in sorted((e for e in epochs if e < below), reverse=True):
        if "_SUCCESS" in (list_folder(spark, f"{path}/epoch={epoch}") or []):
            return spark.read.schema(schema).parquet(f"{path}/epoch={epoch}").first()
    return None


def _order_totals(counts: DataFrame, amounts: DataFrame, n_riders: int):
    """(orders made, active orders, revenue) of per-order (status, rider) counts."""
    long = counts.groupBy("order_id").agg(
        F.sum(F.when(F.col("status") == "pending", F.col("n"))).alias("made"),
        F.count(F.when((F.col("status") == "accepted") & F.col("rider_id").isNotNull(), 1)).alias("accepted"),
        F.count(F.when((F.col("status") == "denied") & F.col("rider_id").isNotNull(), 1)).alias("denied"))
    return (long.join(amounts, "order_id", "left")
            .agg(F.coalesce(F.sum("made"), F.lit(0)).alias("made"),
                 F.count(F.when((F.col("accepted") == 0) & (F.col("denied") < n_riders), 1)).alias("active"),
                 F.sum(F.col("total_amount") * F.col("made")).cast("decimal(20,2)").alias("revenue"))).first()


def kpi_row_writer(path: str, orders: DataFrame, as_of: dt.date, n_riders: int = N_RIDERS, buckets: int = 16):
    """D6 as a stream: a ``foreachBatch`` writer that leaves the day's KPI row of all events so far after every epoch.

    The stream is the status log (``order_id, status, rider_id, event_timestamp``); ``orders`` gives an order's amount and
    user. State: the day's counts per (order, status, rider), and the day each user was first seen with an order. An
    epoch's change is what its orders count for after it less what they counted for before, so an acceptance takes its
    order out of the active ones, and an earlier first sighting that arrives late takes its user out of the new ones.
    The row is written to ``<path>/epoch=<n>``.
    """
    counted = StateTable(path + "-orders", "order_id", COUNTS, buckets)
    seen = StateTable(path + "-users", "user_id", FIRST_SEEN, buckets)
    amounts = orders.select("order_id", "total_amount")

    def write(batch: DataFrame, epoch_id: int, out: str) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz")).persist()
        try:
            row = _last_row(spark, out, TOTALS, epoch_id)
            made, active, revenue, new, last = row if row is not None else (0, 0, None, 0, None)

            today = day_slice(batch, as_of)
            touched = counted.touched(today)
            if touched:
                before = counted.read(spark, epoch_id, touched)
                after = (before.unionByName(today.select("order_id", "status", "rider_id", F.lit(1).cast("long").alias("n")))
                         .groupBy("order_id", "status", "rider_id").agg(F.sum("n").alias("n")))
                counted.write(after, epoch_id, touched)
                after = counted.read(spark, epoch_id + 1, touched)
                near = today.select("order_id").distinct()
                then, now = (_order_totals(x.join(near, "order_id", "left_semi"), amounts, n_riders) for x in (before, after))
                made, active = made + now.made - then.made, active + now.active - then.active
                if now.revenue is not None:
                    revenue = (revenue or 0) + now.revenue - (then.revenue or 0)

            first = (batch.where("status = 'pending'").join(orders.select("order_id", "user_id"), "order_id")
                     .groupBy("user_id").agg(F.to_date(F.min("event_timestamp")).alias("first_day")))
            users = seen.touched(first)
            if users:
                before = seen.read(spark, epoch_id, users)
                seen.write(before.unionByName(first).groupBy("user_id").agg(F.min("first_day").alias("first_day")), epoch_id, users)
                after, of_day = seen.read(spark, epoch_id + 1, users), F.col("first_day") == F.lit(as_of)
                new += after.where(of_day).count() - before.where(of_day).count()

            newest = batch.where("status = 'pending'").agg(F.max("event_timestamp")).first()[0]
            last = max((x for x in (last, newest) if x is not None), default=None)
            (spark.createDataFrame([(made, active, revenue, new, last)], TOTALS).coalesce(1)
             .write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}"))
            counted.compact(spark, epoch_id)
            seen.compact(spark, epoch_id)
        finally:
            batch.unpersist()

    return write


def read_kpi_row(spark, out: str, below: int = 2 ** 62) -> DataFrame:
    """The KPI row of the newest epoch, in the form of ``daily_kpis``; the row of no events if there is none."""
    row = _last_row(spark, out, TOTALS, below)
    df = spark.createDataFrame([tuple(row) if row is not None else (0, 0, None, 0, None)], TOTALS)
    return df.withColumn("last_order_label", F.coalesce(F.date_format("last_order_time", "HH:mm"), F.lit("No orders yet")))


SLOTS = T.StructType([T.StructField("window_start", T.TimestampType()), T.StructField("num_orders", T.LongType()),
                      T.StructField("late_orders", T.LongType())])
MARK = T.StructType([T.StructField("newest", T.TimestampType())])


def slot_writer(path: str, *, delay_seconds: int, minutes: int = 15, buckets: int = 16):
    """D10 as a stream that loses no row: counts per event-time slot, late rows counted beside them.

    The watermark is the newest event time of the earlier epochs less ``delay_seconds``, as Spark's own would be. A
    row of a slot that has ended by then no longer changes ``num_orders``, which readers may already have used, and is
    counted in ``late_orders`` of its slot. The sum of both is the batch count.
    """
    slots = StateTable(path, "window_start", SLOTS, buckets)

    def write(batch: DataFrame, epoch_id: int, out: str) -> None:
        spark = batch.sparkSession
        batch = batch.where(F.col("event_timestamp").isNotNull()).persist()
        try:
            row = _last_row(spark, path + "-mark", MARK, epoch_id)
            newest = row.newest if row is not None else None
            ends = F.window("event_timestamp", f"{minutes} minutes")
            late = F.lit(False) if newest is None else ends["end"] <= F.lit(newest - dt.timedelta(seconds=delay_seconds))
            new = (batch.select(ends["start"].alias("window_start"), late.alias("late"))
                   .groupBy("window_start").agg(F.count(F.when(~F.col("late"), 1)).alias("num_orders"),
                                                F.count(F.when(F.col("late"), 1)).alias("late_orders")))
            touched = slots.touched(new)
            if touched:
                both = slots.read(spark, epoch_id, touched).unionByName(new)
                slots.write(both.groupBy("window_start").agg(F.sum("num_orders").alias("num_orders"),
                                                             F.sum("late_orders").alias("late_orders")), epoch_id, touched)
            here = batch.agg(F.max("event_timestamp")).first()[0]
            newest = max((x for x in (newest, here) if x is not None), default=None)
            spark.createDataFrame([(newest,)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{path}-mark/epoch={epoch_id}")
            slots.compact(spark, epoch_id)
        finally:
            batch.unpersist()

    return write


def read_slots(spark, path: str) -> DataFrame:
    """(window_start, num_orders, late_orders) as the last epoch left them."""
    return StateTable(path, "window_start", SLOTS).read(spark, 2 ** 62)


def match_live(offers: DataFrame, responses: DataFrame, riders: DataFrame, *, within: str, delay: str) -> DataFrame:
    """C10 over two live feeds: responses by known riders to offers at most ``within`` old, as an inner stream-stream join.

    ``offers``: (order_id, offered_at), one row for an order that all riders are offered, so no row per rider exists;
    ``responses``: (order_id, rider_id, status, answered_at). Both have watermarks of ``delay``, and the bound on the
    times lets Spark drop an offer from the state once no answer in time can come, and an answer once no offer can.
    """
    o = offers.select(F.col("order_id").alias("offer"), "offered_at").withWatermark("offered_at", delay)
    known = riders.select("rider_id").distinct()
    r = (responses.join(known, "rider_id", "left_semi")
         .select("order_id", "rider_id", "status", "answered_at").withWatermark("answered_at", delay))
    met = F.expr(f"offer = order_id AND answered_at >= offered_at AND answered_at <= offered_at + INTERVAL {within}")
    return o.join(r, met).select("order_id", "rider_id", "status", "offered_at", "answered_at")
