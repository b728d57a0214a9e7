"""History page (F1-F6): monthly orders and revenue of a year, year range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.functions.time import year_slice
from orderflow.functions.stats import round6


def _year_events(events: DataFrame, year: int, status: str | None) -> DataFrame:
    # Range predicate on the raw column (pushable), not year(ts) = y.
    ev = year_slice(events, year)
    if status is not None:
        ev = ev.filter(F.col("status") == status)
    return ev


def yearly_orders(events: DataFrame, year: int, status: str = "pending") -> DataFrame:
    """pending orders per month of ``year``."""
    return (_year_events(events, year, status)
            .groupBy(F.month("event_timestamp").alias("month"))
            .agg(F.count(F.lit(1)).alias("num_orders"))
            .orderBy("month"))


def _per_order_month(events: DataFrame, year: int, status: str | None) -> DataFrame:
    # One row per (order, month) with its event multiplicity before joining orders.
    return (_year_events(events, year, status)
            .groupBy("order_id", F.month("event_timestamp").alias("month"))
            .agg(F.count(F.lit(1)).alias("n")))


def yearly_revenue(events: DataFrame, orders: DataFrame, year: int,
                   status: str = "pending") -> DataFrame:
    """revenue of the pending orders per month (left join: unknown orders add nothing)."""
    per = _per_order_month(events, year, status)
    return (per.join(orders.select("order_id", "total_amount"), "order_id", "left")
            .groupBy("month")
            .agg(F.sum(F.col("total_amount") * F.col("n")).cast("decimal(20,2)").alias("revenue")))


def region_orders(events: DataFrame, orders: DataFrame, year: int,
                  status: str | None = "pending") -> DataFrame:
    """F3 as intended: events per month and delivery city (city from ``orders``).

    The original reads ``delivery_city`` from the status log, which has no
    such column (T9); here it comes from ``orders``.  ``status=None`` counts
    every event row like the original's missing filter would.
    """
    per = _per_order_month(events, year, status)
    return (per.join(orders.select("order_id", "delivery_city"), "order_id", "left")
            .groupBy("month", "delivery_city")
            .agg(F.sum("n").cast("bigint").alias("num_orders"))
            .orderBy("month", "delivery_city"))


def year_bounds(events: DataFrame, status: str = "pending") -> DataFrame:
    """first and last year with a pending event (NULLs when there is none)."""
    ev = events.filter(F.col("status") == status)
    at = "event_date" if "event_date" in events.columns else "event_timestamp"  # partition value, if there is one
    return ev.agg(F.year(F.min(at)).alias("min_year"), F.year(F.max(at)).alias("max_year"))


def year_list(events: DataFrame, status: str = "pending") -> DataFrame:
    """every year from the first to the last (empty when there are no orders)."""
    b = year_bounds(events, status)
    return b.select(F.explode(F.sequence("min_year", "max_year")).alias("year"))


def yearly_summary(events: DataFrame, orders: DataFrame, year: int) -> DataFrame:
    """monthly orders and revenue side by side, with the charts' 1.1 x max axis limits."""
    o = yearly_orders(events, year).select("month", F.col("num_orders").cast("double").alias("num_orders"))
    r = yearly_revenue(events, orders, year).select("month", F.col("revenue").cast("double").alias("revenue"))
    both = o.join(r, "month", "full")
    # At most 12 rows (months of one year): the axis limits are a window over
    # the whole, proven-small frame instead of a subquery that would compute
    # both monthly aggregates a second time.
    whole = Window.partitionBy()
    return both.select("month", round6(F.col("num_orders")).alias("num_orders"),
                       round6(F.col("revenue")).alias("revenue"),
                       round6(F.max("num_orders").over(whole) * 1.1).alias("orders_max"),
                       round6(F.max("revenue").over(whole) * 1.1).alias("revenues_max"))
