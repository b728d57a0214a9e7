"""History queries over per-day partials: built without every seventh order's rows of two weeks, which then arrive late, so that
those days are derived anew."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orderflow.operators import history_days as days
from orderflow.plans import dashboards  # noqa: F401  (oracles reused below)
from orderflow.plans.catalog import AS_OF, ORACLE_RAW, YEAR, fx, register
from orderflow.session import scratch_path


def _is_late():
    at = F.col("event_timestamp")
    found = (F.pmod("order_id", F.lit(7)) == 0) & (at >= F.lit(AS_OF - dt.timedelta(days=7))) & (at < F.lit(AS_OF + dt.timedelta(days=7)))
    return F.coalesce(found, F.lit(False))


def _counts(spark, sf):
    f = fx(spark, sf)
    log, kept = f.orders_status, days.DayHistory(scratch_path(spark, "history-days"))
    kept.refresh_counts(log.where(~_is_late()), f.orders)
    kept.refresh_counts(log, f.orders, days.touched_days(log.where(_is_late())))
    return kept.counts(spark)


@register("yearly_summary_days", oracle=ORACLE_RAW["yearly_summary"])
def q_yearly_summary_days(spark, sf):
    return days.yearly_summary(_counts(spark, sf), YEAR)


@register("region_orders_days", oracle=ORACLE_RAW["region_orders"])
def q_region_orders_days(spark, sf):
    return days.region_orders(_counts(spark, sf), YEAR)


@register("delays_days", oracle=f"""
SELECT 'accepted' AS status, avg_seconds, avg_label FROM ({ORACLE_RAW['avg_accept']})
UNION ALL SELECT 'completed', avg_seconds, avg_label FROM ({ORACLE_RAW['avg_complete']})
""")
def q_delays_days(spark, sf):
    log, kept = fx(spark, sf).orders_status, days.DayHistory(scratch_path(spark, "history-days"))
    kept.refresh_delays(log.where(~_is_late()))
    kept.refresh_delays(log, days.touched_days(log.where(_is_late())))
    delays = kept.delays(spark)
    rows = [days.avg_delay(delays, AS_OF, s).select(F.lit(s).alias("status"), "avg_seconds", "avg_label")
            for s in days.DELAY_STATUSES]
    return rows[0].union(rows[1])
