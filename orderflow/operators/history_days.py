"""Incremental history (F1-F6, E5/E6): per-day partial aggregates kept beside the status log.

Two tables below one folder, partitioned by ``event_date``:

* ``counts``: (status, delivery_city, n_events, revenue) of a day; revenue sums the order's total once an event.
* ``delays``: (status, num, den) of a day: over all pairs of a ``status`` row of the day and a pending row of its order, the
  sum of their distance in microseconds and the number of pairs.

Both are additive, so a year is the sum of its days and reads one small file a day instead of the log. ``refresh`` derives given days
anew from the log and overwrites their partitions, late rows included: a day's partials depend on the log alone, so
refreshing twice, or again after a failure, gives the same. A day whose rows are gone keeps a partition without counts.

Delays of other days change too when a late pending row arrives: ``delay_days`` names the days that have rows of the orders
that are pending on the given days.

Defined cases: orders that ``orders`` does not hold count with a null city and add no revenue; events without a time belong
to no day and are in no partial, as they are in no year of ``operators.history``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.functions.stats import round6
from orderflow.functions.time import epoch_micros, format_delay
from orderflow.session import list_folder, scratch_path

DELAY_STATUSES = ("accepted", "completed")
COUNTS = "status string, delivery_city string, n_events bigint, revenue decimal(38,2), event_date date"
DELAYS = "status string, num decimal(38,0), den bigint, event_date date"


def by_day(events: DataFrame) -> DataFrame:
    """The log with ``event_date``: the partition column of a day-partitioned log, else derived."""
    return events if "event_date" in events.columns else events.withColumn("event_date", F.to_date("event_timestamp"))


def touched_days(rows: DataFrame) -> DataFrame:
    """(event_date): the days that some rows of the log fall on."""
    return by_day(rows).where("event_date IS NOT NULL").select("event_date").distinct()


def delay_days(events: DataFrame, days: DataFrame) -> DataFrame:
    """(event_date): the given days, and those with an answer to an order that is pending on one of them."""
    log = by_day(events)
    # days of a calendar: a list of them is small however large the log
    moved = log.where(F.col("status") == "pending").join(F.broadcast(days), "event_date", "left_semi").select("order_id").distinct()
    answers = log.where(F.col("status").isin(*DELAY_STATUSES) & F.col("event_date").isNotNull())
    return answers.join(moved, "order_id", "left_semi").select("event_date").union(days).distinct()


def day_counts(events: DataFrame, orders: DataFrame) -> DataFrame:
    """(event_date, status, delivery_city, n_events, revenue)."""
    per = by_day(events).where("event_date IS NOT NULL").groupBy("event_date", "status", "order_id").agg(F.count("*").alias("n"))
    return (per.join(orders.select("order_id", "delivery_city", "total_amount"), "order_id", "left")
            .groupBy("event_date", "status", "delivery_city")
            .agg(F.sum("n").alias("n_events"),
                 F.sum((F.col("total_amount") * F.col("n")).cast("decimal(28,2)")).cast("decimal(38,2)").alias("revenue")))


def day_delays(events: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """(event_date, status, num, den) of the given days or all, against the pending rows of all days."""
    log = by_day(events).where("event_date IS NOT NULL")
    micros = epoch_micros("event_timestamp").cast("decimal(20,0)")
    answers = log.where(F.col("status").isin(*DELAY_STATUSES))
    if days is not None:
        answers = answers.join(F.broadcast(days), "event_date", "left_semi")
    answers = (answers.groupBy("event_date", "status", "order_id").agg(F.count("*").alias("na"), F.sum(micros).alias("sa")))
    pending = log.where(F.col("status") == "pending")
    if days is not None:
        pending = pending.join(answers.select("order_id").distinct(), "order_id", "left_semi")
    pending = (pending.groupBy("order_id").agg(F.count("*").alias("np"), F.sum(micros).alias("sp")))
    num = F.col("sa") * F.col("np") - F.col("sp") * F.col("na")
    return (answers.join(pending, "order_id").groupBy("event_date", "status")
            .agg(F.sum(num.cast("decimal(28,0)")).cast("decimal(38,0)").alias("num"),
                 F.sum(F.col("na") * F.col("np")).alias("den")))


@dataclass(frozen=True)
class DayHistory:
    path: str

    def refresh(self, events: DataFrame, orders: DataFrame, days: DataFrame | None = None) -> None:
        """Derive the partials of ``days`` (event_date) anew from the whole log; all days of the log if not given."""
        if days is not None:
            days = self._listed(days)
        self.refresh_counts(events, orders, days)
        self.refresh_delays(events, days)

    def refresh_counts(self, events: DataFrame, orders: DataFrame, days: DataFrame | None = None) -> None:
        if days is None:
            self._overwrite("counts", day_counts(events, orders).select(*_names(COUNTS)))
            return
        days = self._listed(days)
        of_days = by_day(events).join(F.broadcast(days), "event_date", "left_semi")
        # every day asked for is written, or a day without rows would keep its old partials
        blank = days.select(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("bigint"),
                            F.lit(None).cast("decimal(38,2)"), "event_date")
        self._overwrite("counts", day_counts(of_days, orders).select(*_names(COUNTS)).union(blank))

    def refresh_delays(self, events: DataFrame, days: DataFrame | None = None) -> None:
        if days is None:
            self._overwrite("delays", day_delays(events).select(*_names(DELAYS)))
            return
        days = self._listed(delay_days(events, self._listed(days)))
        blank = days.select(F.lit(None).cast("string"), F.lit(None).cast("decimal(38,0)"), F.lit(0).cast("bigint"), "event_date")
        self._overwrite("delays", day_delays(events, days).select(*_names(DELAYS)).union(blank))

    def _listed(self, days: DataFrame) -> DataFrame:
        """A list of days, found once and read by every step of a refresh."""
        path = scratch_path(days.sparkSession, "days")
        days.select("event_date").where("event_date IS NOT NULL").distinct().coalesce(1).write.parquet(path)
        return days.sparkSession.read.schema("event_date date").parquet(path)

    def _overwrite(self, table: str, rows: DataFrame) -> None:
        # by a number of tasks that is not merged: a task writes one file for each of its days
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        (rows.repartition(tasks, "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("event_date").parquet(f"{self.path}/{table}"))

    def _read(self, spark: SparkSession, table: str, schema: str, size: str) -> DataFrame:
        path = f"{self.path}/{table}"
        if not list_folder(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path).where(F.col(size) > 0)

    def counts(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "counts", COUNTS, "n_events")

    def delays(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "delays", DELAYS, "den")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _year(counts: DataFrame, year: int, status: str | None) -> DataFrame:
    rows = counts.where((F.col("event_date") >= F.lit(dt.date(year, 1, 1))) & (F.col("event_date") < F.lit(dt.date(year + 1, 1, 1))))
    return (rows if status is None else rows.where(F.col("status") == status)).withColumn("month", F.month("event_date"))


def yearly_orders(counts: DataFrame, year: int, status: str = "pending") -> DataFrame:
    """F1 from the days."""
    return _year(counts, year, status).groupBy("month").agg(F.sum("n_events").alias("num_orders")).orderBy("month")


def yearly_revenue(counts: DataFrame, year: int, status: str = "pending") -> DataFrame:
    """F2 from the days."""
    return _year(counts, year, status).groupBy("month").agg(F.sum("revenue").cast("decimal(20,2)").alias("revenue"))


def region_orders(counts: DataFrame, year: int, status: str | None = "pending") -> DataFrame:
    """F3 from the days."""
    return (_year(counts, year, status).groupBy("month", "delivery_city").agg(F.sum("n_events").alias("num_orders"))
            .orderBy("month", "delivery_city"))


def year_bounds(counts: DataFrame, status: str = "pending") -> DataFrame:
    """F4 from the days."""
    return counts.where(F.col("status") == status).agg(F.year(F.min("event_date")).alias("min_year"),
                                                       F.year(F.max("event_date")).alias("max_year"))


def yearly_summary(counts: DataFrame, year: int) -> DataFrame:
    """F6 from the days, in one pass over them."""
    months = (_year(counts, year, "pending").groupBy("month")
              .agg(F.sum("n_events").cast("double").alias("num_orders"),
                   F.sum("revenue").cast("decimal(20,2)").cast("double").alias("revenue")))
    whole = Window.partitionBy()  # at most 12 rows
    return months.select("month", round6(F.col("num_orders")).alias("num_orders"), round6(F.col("revenue")).alias("revenue"),
                         round6(F.max("num_orders").over(whole) * 1.1).alias("orders_max"),
                         round6(F.max("revenue").over(whole) * 1.1).alias("revenues_max"))


def avg_delay(delays: DataFrame, as_of: dt.date, status: str) -> DataFrame:
    """E5/E6 from the day's partials."""
    day = (delays.where((F.col("event_date") == F.lit(as_of)) & (F.col("status") == status))
           .agg(F.sum("num").alias("num"), F.sum("den").alias("den")))
    seconds = F.col("num").cast("double") / F.col("den").cast("double") / 1e6
    return day.select(round6(seconds).alias("avg_seconds"), format_delay(seconds).alias("avg_label"))
