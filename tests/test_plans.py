"""Physical plan shape: no row products, filters and projections reach the scan."""

import datetime as dt
import io
import contextlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orderflow.operators import daily, history
from orderflow.plans import catalog
from orderflow.session import scratch_path
from tests.conftest import SF_SMALL

BATCH = [n for n in entry.queries() if not n.startswith("stream_") and n not in ("route_points", "gate_stream")]


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_row_products(spark, name):
    p = plan_of(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


@pytest.fixture(scope="module")
def log_table(spark):
    path = scratch_path(spark, "log-table")
    catalog.fx(spark, SF_SMALL).orders_status.write.parquet(path)
    return spark.read.parquet(path)


def test_day_filter_pushed_to_scan(spark, log_table):
    p = plan_of(daily.daily_status(log_table, dt.date(1998, 6, 15)))
    assert "PushedFilters: [IsNotNull(event_timestamp), GreaterThanOrEqual(event_timestamp" in p
    assert "ReadSchema: struct<order_id:bigint,status:string,rider_id:int,event_timestamp:timestamp_ntz>" in p


def test_year_filter_pushed_to_scan(spark, log_table):
    p = plan_of(history.yearly_orders(log_table, 1998))
    assert "GreaterThanOrEqual(event_timestamp,1998-01-01T00:00)" in p
    assert "LessThan(event_timestamp,1999-01-01T00:00)" in p
    assert "ReadSchema: struct<status:string,event_timestamp:timestamp_ntz>" in p


def test_slot_series_is_an_equi_join(spark, log_table):
    p = plan_of(daily.orders_by_slot(log_table, dt.date(1998, 6, 15)))
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p


def test_day_partitioned_log_prunes_and_agrees(spark, log_table):
    from orderflow.sources.layout import write_event_log
    path = scratch_path(spark, "log-by-day")
    write_event_log(catalog.fx(spark, SF_SMALL).orders_status, path, mode="overwrite")
    by_day = spark.read.parquet(path)
    day = dt.date(1998, 6, 15)
    p = plan_of(daily.daily_status(by_day, day))
    assert "PartitionFilters: [isnotnull(event_date" in p and "(event_date" in p
    assert daily.daily_status(by_day, day).collect() == daily.daily_status(log_table, day).collect()
    assert (history.yearly_orders(by_day, 1998).collect() == history.yearly_orders(log_table, 1998).collect())


@pytest.mark.parametrize("name", ["gate_batch", "gate_batch_log"])
def test_gate_ranks_with_partial_top_k(spark, name):
    # The quorum lookup keeps at most n_riders candidates per order per map task.
    p = plan_of(entry.queries()[name](spark, SF_SMALL))
    assert "row_number(), 3, Partial" in p and "row_number(), 3, Final" in p


def test_lake_layout_tables_give_same_results(spark):
    from orderflow.sources.layout import write_event_log
    from orderflow.sources.tables import read_order_tables_lake
    f = catalog.fx(spark, SF_SMALL)
    base = scratch_path(spark, "lake")
    write_event_log(f.orders_status, base + "/orders_status", mode="overwrite")
    f.orders.withColumn("delivery_instructions", F.lit(None).cast("string")) \
        .withColumn("order_created_timestamp", F.lit(None).cast("timestamp_ntz")).write.parquet(base + "/orders")
    f.users.write.parquet(base + "/users")
    f.menu_items.write.parquet(base + "/menu_items")
    f.order_details.write.parquet(base + "/order_details")
    f.roster.write.parquet(base + "/riders")
    t = read_order_tables_lake(spark, base)
    day = dt.date(1998, 6, 15)
    got = daily.daily_kpis(t["orders_status"], t["orders"], t["users"], day).collect()
    assert got == daily.daily_kpis(f.orders_status, f.orders, f.users, day).collect()
    got = daily.food_mix(t["orders_status"], t["order_details"], t["menu_items"], day).collect()
    assert sorted(got) == sorted(daily.food_mix(f.orders_status, f.order_details, f.menu_items, day).collect())


def test_bucketed_orders_join_without_shuffling_orders(spark):
    """With orders bucketed by order_id (bucket count = shuffle partitions), the per-order
    KPI frame joins the fact table bucket-to-partition: the orders side is not shuffled."""
    from orderflow.sources.layout import write_bucketed
    f = catalog.fx(spark, SF_SMALL)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "orders_bucketed_" + scratch_path(spark, "x")[-12:]
    (f.orders.write.option("path", scratch_path(spark, "orders-bucketed"))
     .bucketBy(n, "order_id").sortBy("order_id").format("parquet").saveAsTable(name))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        day = dt.date(1998, 6, 15)
        bucketed = plan_of(daily.daily_kpis(f.orders_status, spark.table(name), f.users, day))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    tree = bucketed.split("\n\n")[0].splitlines()
    at = next(i for i, line in enumerate(tree) if name in line)
    path = []
    depth = len(tree[at]) - len(tree[at].lstrip(" :+-"))
    for line in reversed(tree[:at]):  # walk up to the join that reads the bucketed scan
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            path.append(line.strip(" :+-"))
            depth = d
            if "Join" in line:
                break
    assert path and "SortMergeJoin" in path[-1], path
    assert not any("Exchange" in p for p in path), path
