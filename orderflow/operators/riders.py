"""Riders page."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.time import day_slice, range_slice

RIDER_STATUSES = ("accepted", "denied", "completed")


def n_riders(riders: DataFrame) -> DataFrame:
    """G1."""
    return riders.agg(F.countDistinct("rider_id").alias("n_riders"))


def riders_list(riders: DataFrame) -> DataFrame:
    """G2."""
    return riders.select("rider_id", "name")


def rider_id_by_name(riders: DataFrame, name: str) -> DataFrame:
    """The first rider id carrying ``name`` (NULL when none)."""
    return riders.filter(F.col("name") == name).agg(F.min("rider_id").alias("rider_id"))


def rider_status_matrix(events: DataFrame, riders: DataFrame, as_of: dt.date,
                        statuses: tuple[str, ...] = RIDER_STATUSES) -> DataFrame:
    """Per rider *name* and status, the day's event count, zero-filled.

    The day's events are aggregated to (rider, status) counts first, so the
    fact side reaching the join has at most riders x statuses rows.  The
    grid of (rider, status) pairs comes from exploding a literal status
    array per rider, not from a product of frames.  Riders sharing a name
    are merged, as in the original grouping by name (T18).
    """
    counts = (day_slice(events, as_of).filter(F.col("status").isin(*statuses))
              .groupBy("rider_id", "status")
              .agg(F.count("order_id").alias("c")))
    grid = riders.select("rider_id", "name",
                         F.explode(F.array(*[F.lit(s) for s in statuses])).alias("status"))
    return (grid.join(counts, ["rider_id", "status"], "left")
            .groupBy("name", "status")
            .agg(F.sum(F.coalesce(F.col("c"), F.lit(0))).cast("bigint").alias("count_orders"))
            .orderBy("name", "status"))


def rider_daily(events: DataFrame, rider_id: int, start: dt.date, end: dt.date) -> DataFrame:
    """Completed and denied events per day for one rider, every day present.

    The rider's events in the range collapse to one row per day before the
    equi-join with the day spine (both sides bounded by the day count).
    """
    spark = events.sparkSession
    n_days = (end - start).days + 1
    spine = spark.range(max(n_days, 0)).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    ev = range_slice(events, start, end).filter(F.col("rider_id") == rider_id)
    per_day = (ev.groupBy(F.to_date("event_timestamp").alias("day"))
               .agg(F.count(F.when(F.col("status") == "completed", 1)).alias("c"),
                    F.count(F.when(F.col("status") == "denied", 1)).alias("d")))
    return (spine.join(F.broadcast(per_day), "day", "left")
            .select("day", F.coalesce("c", F.lit(0)).cast("bigint").alias("completed_order_count"),
                    F.coalesce("d", F.lit(0)).cast("bigint").alias("denied_order_count"))
            .orderBy("day"))


def month_to_date(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Default range, first of the month to the reporting day."""
    return as_of.replace(day=1), as_of


def rider_daily_long(daily: DataFrame) -> DataFrame:
    """Wide-to-long (one row per day and series) for plotting."""
    return daily.unpivot(["day"], ["completed_order_count", "denied_order_count"], "variable", "value")
