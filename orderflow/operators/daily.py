"""Daily analytics (dashboard pages 1 and 2): D1-D13, E1-E8.

All daily operators scan the status log once per day slice.  The slice is
reduced to one row per order (``order_day_stats``) before anything else
happens; every KPI is a conditional aggregate over that per-order frame.
Aggregations run partial (map-side) first, so an order or a day holding a
large share of the events collapses to a few rows before any shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.time import day_range, day_slice, epoch_micros, format_delay, range_slice
from orderflow.functions.stats import round6, share_of_total
from orderflow.schemas import N_RIDERS


def _when_status(status: str, value: Column | int) -> Column:
    return F.when(F.col("status") == status, value)


def order_status_stats(events: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Per order: event rows by status and distinct accepting/denying riders.

    ``as_of=None`` uses the whole log (the gate's "all time" scope), otherwise
    only events stamped on that day (the dashboards' scope, trap T2).

    Plan: distinct (order, status, rider) triples with their row counts first
    (partial aggregation collapses duplicates map-side), then one conditional
    aggregate per order.  This replaces two ``COUNT(DISTINCT CASE ...)``
    which Spark would evaluate by duplicating every input row via ``Expand``.
    """
    ev = events if as_of is None else day_slice(events, as_of)
    triples = (ev.groupBy("order_id", "status", "rider_id")
                 .agg(F.count(F.lit(1)).alias("n")))
    rider_known = F.col("rider_id").isNotNull()
    return triples.groupBy("order_id").agg(
        F.coalesce(F.sum(_when_status("pending", F.col("n"))), F.lit(0)).alias("n_pending"),
        F.coalesce(F.sum(_when_status("accepted", F.col("n"))), F.lit(0)).alias("n_accepted"),
        F.coalesce(F.sum(_when_status("denied", F.col("n"))), F.lit(0)).alias("n_denied"),
        F.coalesce(F.sum(_when_status("completed", F.col("n"))), F.lit(0)).alias("n_completed"),
        F.count(F.when((F.col("status") == "accepted") & rider_known, 1)).alias("accepted_riders"),
        F.count(F.when((F.col("status") == "denied") & rider_known, 1)).alias("denied_riders"),
    )


def _is_active(n_riders: int) -> Column:
    return (F.col("accepted_riders") == 0) & (F.col("denied_riders") < n_riders)


def active_orders(events: DataFrame, n_riders: int = N_RIDERS,
                  as_of: dt.date | None = None) -> DataFrame:
    """Orders nobody accepted and fewer than ``n_riders`` riders denied.

    ``as_of=None`` counts over the whole log; with a day only that day's
    events are looked at, so an order accepted yesterday and completed today
    counts as active (reproduced on purpose, trap T2).
    """
    stats = order_status_stats(events, as_of)
    return stats.agg(F.count(F.when(_is_active(n_riders), 1)).alias("active_orders"))


def day_summary(events: DataFrame, as_of: dt.date, n_riders: int = N_RIDERS) -> DataFrame:
    """One row of day counts, all from a single pass over the day slice.

    ``denied_orders`` counts orders with exactly ``n_riders`` denial *rows*
    (not distinct riders) on the day, as the dashboard does (trap T4).
    """
    stats = order_status_stats(events, as_of)
    return stats.agg(
        F.coalesce(F.sum("n_pending"), F.lit(0)).cast("bigint").alias("total_orders"),
        F.count(F.when(_is_active(n_riders), 1)).alias("pending_orders"),
        F.coalesce(F.sum("n_accepted"), F.lit(0)).cast("bigint").alias("accepted_orders"),
        F.count(F.when(F.col("n_denied") == n_riders, 1)).alias("denied_orders"),
        F.coalesce(F.sum("n_completed"), F.lit(0)).cast("bigint").alias("completed_orders"),
    )


def success_rate(completed: Column, total: Column) -> Column:
    """Completed / total in percent, 2 decimals half-even; 0 when no orders.

    Can exceed 100 because both counts are event rows of the day (T10).
    """
    pct = completed.cast("double") / F.when(total != 0, total.cast("double")) * 100
    return F.when(total != 0, F.bround(pct, 2)).otherwise(F.lit(0.0))


def daily_status(events: DataFrame, as_of: dt.date, n_riders: int = N_RIDERS) -> DataFrame:
    """Total, pending, accepted, denied, completed and success rate of a day."""
    s = day_summary(events, as_of, n_riders)
    return s.withColumn("success_rate", success_rate(F.col("completed_orders"), F.col("total_orders")))


def denied_orders(events: DataFrame, as_of: dt.date, n_riders: int = N_RIDERS) -> DataFrame:
    """E2 as a list: the orders with exactly ``n_riders`` denial rows on the day."""
    stats = order_status_stats(events, as_of)
    return stats.filter(F.col("n_denied") == n_riders).select("order_id", "n_denied")


def daily_kpis(events: DataFrame, orders: DataFrame, users: DataFrame, as_of: dt.date,
               n_riders: int = N_RIDERS) -> DataFrame:
    """D6 (flagship): orders made, active orders, revenue, new customers, last order.

    Revenue joins the day's per-order counts (one row per order) to the
    orders table instead of joining every event row, inside the same
    aggregate as the counts; the join strategy is left to AQE (broadcast of
    the measured per-order side when small, otherwise a shuffle join that a
    bucketed ``orders`` table serves without moving the fact side; ``order_id``
    is the primary key of ``orders``, so the join adds no rows).  New
    customers and the last order time come from other sources and are
    scalar subqueries, so the output is one row without any product of
    frames.
    """
    stats = order_status_stats(events, as_of)
    amounts = orders.select("order_id", "total_amount")
    new_customers = (users.filter(F.col("registration_date") == F.lit(as_of))
                     .agg(F.countDistinct("user_id").alias("c")).scalar())
    made = events.filter(F.col("status") == "pending")
    if "event_date" in events.columns:  # day-partitioned log: only the newest day with an order is read for its time
        made = made.filter(F.col("event_date") == made.agg(F.max("event_date").alias("d")).scalar())
    last = made.agg(F.max("event_timestamp").alias("m")).scalar()
    pending_amount = F.when(F.col("n_pending") > 0, F.col("total_amount") * F.col("n_pending"))
    return (stats.join(amounts, "order_id", "left")
            .agg(F.coalesce(F.sum("n_pending"), F.lit(0)).cast("bigint").alias("total_orders"),
                 F.count(F.when(_is_active(n_riders), 1)).alias("active_orders"),
                 F.sum(pending_amount).cast("decimal(20,2)").alias("revenue"))
            .select("total_orders", "active_orders", "revenue",
                    new_customers.alias("new_customers"),
                    last.alias("last_order_time"))
            .withColumn("last_order_label",
                        F.coalesce(F.date_format("last_order_time", "HH:mm"), F.lit("No orders yet"))))


# -- product mixes --------------------------------------------------------

def _order_weights(events: DataFrame, as_of: dt.date, status: str | None) -> DataFrame:
    """Per order, how many matching status rows it has on the day.

    Joining order lines to this instead of to raw events keeps the literal
    SQL's multiplicity (each line counted once per matching event row) while
    the big side joins a frame with one row per order.
    """
    ev = day_slice(events, as_of)
    if status is not None:
        ev = ev.filter(F.col("status") == status)
    return ev.groupBy("order_id").agg(F.count(F.lit(1)).alias("w"))


def item_mix(events: DataFrame, details: DataFrame, menu: DataFrame, as_of: dt.date, *,
             drinks: bool, status: str | None = "pending", with_revenue: bool = False) -> DataFrame:
    """Quantity (and revenue) per food category or per drink name.

    ``status='pending'`` is the pie charts' query; ``status=None`` is the
    literal detail tables, which multiply each line by its number of events
    that day (trap T3).  Food is ``category != 'Drink'``, which drops NULL
    categories (T17).

    Lines are first reduced to one row per item (partial aggregation), and
    only then joined to the menu on ``item_id``; the menu is never assumed
    small (it grows with the catalogue), AQE decides the join strategy.
    """
    w = _order_weights(events, as_of, status)
    per_item = (details.join(w, "order_id")
                .groupBy("item_id")
                .agg(F.sum(F.col("quantity") * F.col("w")).alias("q"),
                     F.sum(F.col("subtotal") * F.col("w")).alias("rev")))
    key = "name" if drinks else "category"
    cat = F.col("category")
    m = menu.filter(cat == "Drink" if drinks else cat != "Drink").select("item_id", key)
    out = (per_item.join(m, "item_id")
           .groupBy(key)
           .agg(F.sum("q").cast("bigint").alias("quantity"),
                F.sum("rev").cast("decimal(20,2)").alias("total_revenue")))
    if with_revenue:
        return out.orderBy(F.col("total_revenue").desc_nulls_first())
    return out.select(key, "quantity")


def food_mix(events, details, menu, as_of, status="pending"):
    return item_mix(events, details, menu, as_of, drinks=False, status=status)


def drink_mix(events, details, menu, as_of, status="pending"):
    return item_mix(events, details, menu, as_of, drinks=True, status=status)


def food_revenue(events, details, menu, as_of, status=None):
    return item_mix(events, details, menu, as_of, drinks=False, status=status, with_revenue=True)


def drink_revenue(events, details, menu, as_of, status=None):
    return item_mix(events, details, menu, as_of, drinks=True, status=status, with_revenue=True)


def with_share(df: DataFrame, value: str = "quantity") -> DataFrame:
    """Each slice's share of the total (what the pie charts print)."""
    return share_of_total(df, value)


# -- time series ------------------------------------------------------------

def orders_by_slot(events: DataFrame, as_of: dt.date, slot_minutes: int = 15,
                   status: str = "pending") -> DataFrame:
    """Events per fixed slot of the day, every slot present (zeros kept).

    The literal SQL range-joins a generated series with the events, which
    Spark can only run as a nested-loop join.  Here the day's events are
    bucketed by arithmetic (an equi key), partially aggregated to at most
    one row per slot, and joined to the slot spine on equality.  Both sides
    are bounded by the number of slots in a day.
    """
    lo, _ = day_range(as_of)
    n_slots = (24 * 60 - 1) // slot_minutes + 1
    spark = events.sparkSession
    spine = spark.range(n_slots).select(
        F.timestamp_add("MINUTE", F.col("id") * slot_minutes, lo).alias("time_window"))
    ev = day_slice(events, as_of).filter(F.col("status") == status)
    minutes = F.timestamp_diff("MINUTE", lo, F.col("event_timestamp"))
    counts = (ev.select(F.timestamp_add("MINUTE", F.floor(minutes / slot_minutes) * slot_minutes, lo)
                        .alias("time_window"))
              .groupBy("time_window").agg(F.count(F.lit(1)).alias("n")))
    return (spine.join(F.broadcast(counts), "time_window", "left")
            .select("time_window", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("num_orders"))
            .orderBy("time_window"))


# -- delays ------------------------------------------------------------------

def avg_delay(events: DataFrame, as_of: dt.date, status: str, lookback_days: int | None = None) -> DataFrame:
    """Mean time from an order's *pending* row to its ``status`` rows of the day.

    The literal self-join pairs every ``status`` row with every pending row
    of the order.  Pending rows are pre-aggregated per order to
    ``(count, sum of micros)``, so the mean over all pairs is
    ``sum(a * n - S) / sum(n)`` without materialising pairs.  Exact in
    integer microseconds (the dashboard's ``avg(interval)``; T14).

    Pending rows are first semi-joined to the day's orders, so the history
    is filtered before it is aggregated. ``lookback_days`` also bounds it by
    date (on a day-partitioned log: by partition), for orders that are known
    to be placed at most that many days before their ``status`` row; rows
    after the day are then left out too.
    """
    tgt = (day_slice(events, as_of).filter(F.col("status") == status)
           .select("order_id", epoch_micros("event_timestamp").alias("a")))
    history = events if lookback_days is None else \
        range_slice(events, as_of - dt.timedelta(days=lookback_days), as_of)
    pend = (history.filter(F.col("status") == "pending")
            .join(tgt.select("order_id").distinct(), "order_id", "left_semi")
            .groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("np"), F.sum(epoch_micros("event_timestamp")).alias("sp")))
    agg = (tgt.join(pend, "order_id")
           .agg(F.sum(F.col("a") * F.col("np") - F.col("sp")).alias("num"),
                F.sum("np").alias("den")))
    secs = F.col("num").cast("double") / F.col("den").cast("double") / 1e6
    return agg.select(round6(secs).alias("avg_seconds"), format_delay(secs).alias("avg_label"))
