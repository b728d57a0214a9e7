"""Money with cents, order of results, pruned history."""

import datetime as dt
from decimal import Decimal

from orderflow.operators import daily, history, legacy
from orderflow.plans import catalog
from orderflow.session import scratch_path
from orderflow.sources import tables
from orderflow.sources.layout import write_event_log
from tests.conftest import SF_SMALL
from tests.helpers import events_df


def test_decimal_cost_keeps_its_cents(spark):
    df = spark.sql("SELECT 0 AS order_completed, cast(1.75 AS decimal(38,2)) AS cost UNION ALL SELECT 1, 2.50")
    assert legacy.legacy_totals(df).first().total_revenue == Decimal("4.25")


def test_region_orders_come_in_order(spark):
    f = catalog.fx(spark, SF_SMALL)
    got = [(r.month, r.delivery_city) for r in history.region_orders(f.orders_status, f.orders, 1998).collect()]
    assert got == sorted(got) and len(got) > 12


def test_avg_delay_with_and_without_lookback(spark):
    ev = events_df(spark, [(1, "pending", None, "2024-03-03 10:00:00"), (1, "accepted", 1, "2024-03-03 10:10:00"),
                           (2, "pending", None, "2024-03-02 23:50:00"), (2, "accepted", 1, "2024-03-03 00:10:00"),
                           (3, "pending", None, "2024-03-01 10:00:00")])
    for days in (None, 1, 5):
        assert daily.avg_delay(ev, dt.date(2024, 3, 3), "accepted", lookback_days=days).first().avg_seconds == 900


def test_history_reads_partitions(spark):
    f = catalog.fx(spark, SF_SMALL)
    path = scratch_path(spark, "log")
    write_event_log(f.orders_status, path)
    log = spark.read.parquet(path)
    days = log.select("event_date").distinct().count()
    assert len(log.inputFiles()) <= days + int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = history.year_bounds(f.orders_status).first()
    assert history.year_bounds(log).first() == want
    plan = history.year_bounds(log)._jdf.queryExecution().executedPlan().toString()
    assert "event_timestamp" not in plan
    a = daily.daily_kpis(f.orders_status, f.orders, f.users, catalog.AS_OF).first()
    assert daily.daily_kpis(log, f.orders, f.users, catalog.AS_OF).first() == a


def test_jdbc_facts_are_read_in_ranges(spark, monkeypatch):
    """Against a stand-in for the reader: bounds given are used, others are asked for, empty tables get none."""
    asked = {}

    def reader(_spark, _url, table, *, properties=None, **ranges):
        if "bounds" in table:
            return spark.sql("SELECT CAST(NULL AS INT) AS lo, CAST(NULL AS INT) AS hi" if ".users" in table
                             else "SELECT 3 AS lo, 900 AS hi")
        asked[table.split(".")[1]] = ranges
        cols = ", ".join(f"1 AS {c}" for c in tables.ORDER_TABLES[table.split(".")[1]])
        return spark.sql(f"SELECT {cols}")

    monkeypatch.setattr(tables, "read_jdbc_table", reader)
    found = tables.read_order_tables_jdbc(spark, "url", {}, key_bounds={"orders": (1, 50)}, num_partitions=8)
    assert set(found) == set(tables.ORDER_TABLES) == set(asked)
    ranged = {t: (r["partition_column"], r["lower_bound"], r["upper_bound"], r["num_partitions"])
              for t, r in asked.items() if r}
    assert ranged == {"orders": ("order_id", 1, 50, 8), "orders_status": ("order_id", 3, 900, 8),
                      "order_details": ("order_id", 3, 900, 8)}
