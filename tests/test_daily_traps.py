"""Hand cases for the dashboard semantics."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from orderflow.operators import daily, riders, menu, history
from orderflow.functions.time import format_delay
from tests.helpers import events_df, rows, seed_menu, seed_riders

DAY = dt.date(2024, 3, 10)


def test_active_day_scope_counts_order_accepted_yesterday(spark):
    # Accepted before midnight, completed after -> active "today".
    ev = events_df(spark, [
        (1, "pending", None, "2024-03-09 23:50:00"),
        (1, "accepted", 2, "2024-03-09 23:55:00"),
        (1, "completed", 2, "2024-03-10 00:20:00"),
        (2, "pending", None, "2024-03-10 08:00:00"),
        (2, "accepted", 1, "2024-03-10 08:01:00"),
    ])
    assert daily.active_orders(ev, 3, DAY).first()["active_orders"] == 1
    assert daily.active_orders(ev, 3, None).first()["active_orders"] == 0


def test_denied_rows_vs_distinct_riders(spark):
    # T4/T5: a rider denying twice makes 3 rows but 2 distinct deniers.
    ev = events_df(spark, [
        (5, "pending", None, "2024-03-10 09:00:00"),
        (5, "denied", 1, "2024-03-10 09:01:00"),
        (5, "denied", 1, "2024-03-10 09:02:00"),
        (5, "denied", 2, "2024-03-10 09:03:00"),
    ])
    s = daily.daily_status(ev, DAY, 3).first()
    assert s["denied_orders"] == 1          # exactly 3 denial rows
    assert s["pending_orders"] == 1         # only 2 distinct deniers -> still active


def test_success_rate_can_exceed_100_and_zero_when_empty(spark):
    # Completions of earlier orders counted against today's new orders.
    ev = events_df(spark, [
        (1, "pending", None, "2024-03-10 10:00:00"),
        (2, "completed", 1, "2024-03-10 10:00:00"),
        (3, "completed", 1, "2024-03-10 11:00:00"),
    ])
    assert daily.daily_status(ev, DAY, 3).first()["success_rate"] == 200.0
    empty = daily.daily_status(ev, dt.date(2020, 1, 1), 3).first()
    assert empty["total_orders"] == 0 and empty["success_rate"] == 0.0


def test_success_rate_half_even(spark):
    # Bround, not half-up.
    df = spark.createDataFrame([(1, 8)], "c long, t long")
    v = df.select(daily.success_rate(F.col("c"), F.col("t")).alias("r")).first()["r"]
    assert v == 12.5


def test_kpis_empty_day(spark):
    # Revenue NULL, label "No orders yet" only when there is no pending row at all.
    ev = events_df(spark, [(1, "accepted", 1, "2024-03-10 10:00:00")])
    orders = spark.createDataFrame([(1, Decimal("9.99"))], "order_id long, total_amount decimal(10,2)")
    users = spark.createDataFrame([(1, dt.date(2024, 3, 10))], "user_id long, registration_date date")
    k = daily.daily_kpis(ev, orders, users, DAY, 3).first()
    assert k["total_orders"] == 0 and k["revenue"] is None and k["new_customers"] == 1
    assert k["last_order_label"] == "No orders yet"


def test_kpis_revenue_counts_each_pending_row(spark):
    ev = events_df(spark, [
        (1, "pending", None, "2024-03-10 10:00:00"),
        (2, "pending", None, "2024-03-10 12:34:00"),
        (3, "pending", None, "2024-03-09 12:00:00"),
    ])
    orders = spark.createDataFrame([(1, Decimal("10.00")), (2, Decimal("5.50")), (3, Decimal("1.00"))],
                                   "order_id long, total_amount decimal(10,2)")
    users = spark.createDataFrame([], "user_id long, registration_date date")
    k = daily.daily_kpis(ev, orders, users, DAY, 3).first()
    assert k["revenue"] == Decimal("15.50") and k["total_orders"] == 2
    assert k["last_order_label"] == "12:34"


def test_literal_mix_multiplies_lines_by_event_rows(spark):
    # The detail table counts each line once per event row of the day.
    m = seed_menu(spark)
    details = spark.createDataFrame([(1, 1, 2, Decimal("19.98")), (1, 9, 1, Decimal("3.50"))],
                                    "order_id long, item_id long, quantity int, subtotal decimal(10,2)")
    ev = events_df(spark, [
        (1, "pending", None, "2024-03-10 10:00:00"),
        (1, "accepted", 1, "2024-03-10 10:05:00"),
        (1, "completed", 1, "2024-03-10 10:30:00"),
    ])
    assert rows(daily.food_mix(ev, details, m, DAY)) == [("Pizza", 2)]
    lit = daily.food_revenue(ev, details, m, DAY, status=None)
    assert rows(lit) == [("Pizza", 6, Decimal("59.94"))]
    assert rows(daily.drink_mix(ev, details, m, DAY)) == [("Coca-Cola", 1)]


def test_food_excludes_null_category(spark):
    # Category != 'Drink' drops NULL categories.
    m = spark.createDataFrame([(1, "x", None, Decimal("1.00"), None, None)], seed_menu(spark).schema)
    details = spark.createDataFrame([(1, 1, 1, Decimal("1.00"))],
                                    "order_id long, item_id long, quantity int, subtotal decimal(10,2)")
    ev = events_df(spark, [(1, "pending", None, "2024-03-10 10:00:00")])
    assert daily.food_mix(ev, details, m, DAY).count() == 0


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, quantity long")
    out = dict(rows(daily.with_share(df), "k", "share"))
    assert out == {"a": 0.25, "b": 0.75}


def test_slots_are_zero_filled(spark):
    ev = events_df(spark, [(1, "pending", None, "2024-03-10 00:14:59"),
                           (2, "pending", None, "2024-03-10 23:59:59"),
                           (3, "accepted", 1, "2024-03-10 05:00:00")])
    out = daily.orders_by_slot(ev, DAY).collect()
    assert len(out) == 96 and sum(r["num_orders"] for r in out) == 2
    assert out[0]["num_orders"] == 1 and out[-1]["num_orders"] == 1


def test_avg_delay_and_label(spark):
    ev = events_df(spark, [
        (1, "pending", None, "2024-03-10 10:00:00"),
        (1, "accepted", 1, "2024-03-10 10:01:30"),
        (2, "pending", None, "2024-03-10 11:00:00"),
        (2, "accepted", 2, "2024-03-10 11:02:00"),
    ])
    r = daily.avg_delay(ev, DAY, "accepted").first()
    assert r["avg_seconds"] == 105.0 and r["avg_label"] == "1'45''"
    none = daily.avg_delay(ev, DAY, "completed").first()
    assert none["avg_seconds"] is None and none["avg_label"] == "0'0''"


def test_format_delay_floors_like_python(spark):
    # int(s // 60), int(s % 60) with Python's floor semantics.
    df = spark.createDataFrame([(59.9,), (-61.0,), (None,)], "s double")
    got = [r[0] for r in df.select(format_delay(F.col("s"))).collect()]
    py = [f"{int(s // 60)}'{int(s % 60)}''" for s in (59.9, -61.0, 0)]
    assert got == py


def test_rider_matrix_zero_fill_and_name_merge(spark):
    # Riders sharing a name are merged.
    rs = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (3, "Bob")], "rider_id int, name string")
    ev = events_df(spark, [(9, "accepted", 1, "2024-03-10 10:00:00"),
                           (8, "accepted", 2, "2024-03-10 10:00:00"),
                           (7, "denied", 3, "2024-03-09 10:00:00")])
    out = rows(riders.rider_status_matrix(ev, rs, DAY))
    assert out == [("Ann", "accepted", 2), ("Ann", "completed", 0), ("Ann", "denied", 0),
                   ("Bob", "accepted", 0), ("Bob", "completed", 0), ("Bob", "denied", 0)]


def test_rider_daily_spine(spark):
    ev = events_df(spark, [(1, "completed", 1, "2024-03-02 10:00:00"),
                           (2, "denied", 1, "2024-03-02 11:00:00"),
                           (3, "denied", 2, "2024-03-02 11:00:00")])
    d = riders.rider_daily(ev, 1, dt.date(2024, 3, 1), dt.date(2024, 3, 3))
    assert rows(d) == [(dt.date(2024, 3, 1), 0, 0), (dt.date(2024, 3, 2), 1, 1), (dt.date(2024, 3, 3), 0, 0)]
    assert riders.rider_daily_long(d).count() == 6


def test_seed_riders_and_menu(spark):
    rs = seed_riders(spark)
    assert riders.n_riders(rs).first()[0] == 4
    assert riders.rider_id_by_name(rs, "Matteo").first()[0] == 3
    m = seed_menu(spark)
    cc = [(r["category"], r["count"]) for r in menu.category_counts(m).collect()]
    assert cc[0] == ("Pizza", 3) and dict(cc)["Drink"] == 2
    assert rows(menu.menu_by_kind(m).filter("kind = 'drink'"), "name") == [("Coca-Cola",), ("Water",)]


def test_price_density_matches_numpy(spark):
    import numpy as np
    m = seed_menu(spark)
    prices = np.array([float(r["price"]) for r in m.collect()])
    h = prices.std(ddof=1) * len(prices) ** -0.2
    grid = prices.min() + np.arange(500) * (prices.max() - prices.min()) / 500
    ref = np.exp(-0.5 * ((grid[:, None] - prices[None, :]) / h) ** 2).sum(1) / (len(prices) * h * np.sqrt(2 * np.pi))
    got = {r["point"]: r["density"] for r in menu.price_density(m).collect()}
    assert len(got) == 500
    assert max(abs(got[k] - ref[k]) for k in range(500)) < 2e-6


def test_year_list_empty_without_orders(spark):
    ev = events_df(spark, [(1, "accepted", 1, "2024-03-10 10:00:00")])
    assert history.year_list(ev).count() == 0


def test_rider_orders_nulls_first_and_earliest_acceptance(spark):
    # DESC puts NULL acceptance times first (PostgreSQL order);
    # An order with two acceptances takes the earliest instead of failing.
    from orderflow.operators import lifecycle
    ev = events_df(spark, [
        (1, "pending", None, "2024-03-10 10:00:00"),
        (1, "completed", 7, "2024-03-10 10:30:00"),            # completed without an acceptance row
        (2, "pending", None, "2024-03-10 11:00:00"),
        (2, "accepted", 7, "2024-03-10 11:05:00"),
        (2, "accepted", 8, "2024-03-10 11:02:00"),
        (2, "completed", 7, "2024-03-10 11:40:00"),
        (3, "pending", None, "2024-03-10 12:00:00"),
        (3, "accepted", 7, "2024-03-10 12:01:00"),             # still open -> listed as accepted
    ])
    orders = spark.createDataFrame([(1, Decimal("1.00")), (2, Decimal("2.00")), (3, Decimal("3.00"))],
                                   "order_id long, total_amount decimal(10,2)")
    out = lifecycle.rider_orders(ev, orders, 7).collect()
    assert [(r["order_id"], r["status"]) for r in out] == [(1, "completed"), (3, "accepted"), (2, "completed")]
    assert out[0]["order_acceptance_timestamp"] is None
    assert out[2]["order_acceptance_timestamp"] == dt.datetime(2024, 3, 10, 11, 2)
