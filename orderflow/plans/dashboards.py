"""Dashboard queries: daily KPIs and status (D, E), history (F), riders (G), menu (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.functions.stats import share_of_total
from orderflow.operators import daily, history, menu, riders
from orderflow.operators import ingest as menu_ingest
from orderflow.plans import closed_form
from orderflow.plans.catalog import AS_OF, N, RIDER, RIDER_NAME, YEAR, fx, register

DAY = "DATE '1998-06-15'"

@register("daily_kpis", oracle=closed_form.DAILY_KPIS, headline=True)
def q_daily_kpis(spark, sf):
    f = fx(spark, sf)
    return daily.daily_kpis(f.orders_status, f.orders, f.users, AS_OF, N)


@register("active_orders_day", oracle=closed_form.ACTIVE_TODAY)
def q_active_orders_day(spark, sf):
    return daily.active_orders(fx(spark, sf).orders_status, N, AS_OF)


@register("active_orders_all", oracle=closed_form.ACTIVE_ALL, headline=True)
def q_active_orders_all(spark, sf):
    return daily.active_orders(fx(spark, sf).orders_status, N, None)


@register("daily_status", oracle=closed_form.DAILY_STATUS, headline=True)
def q_daily_status(spark, sf):
    return daily.daily_status(fx(spark, sf).orders_status, AS_OF, N)


@register("denied_orders", oracle=closed_form.DENIED_ORDERS)
def q_denied_orders(spark, sf):
    return daily.denied_orders(fx(spark, sf).orders_status, AS_OF, N)


@register("food_mix", oracle=closed_form.mix("category", False, True, False), headline=True)
def q_food_mix(spark, sf):
    f = fx(spark, sf)
    return daily.food_mix(f.orders_status, f.order_details, f.menu_items, AS_OF)


@register("drink_mix", oracle=closed_form.mix("name", True, True, False))
def q_drink_mix(spark, sf):
    f = fx(spark, sf)
    return daily.drink_mix(f.orders_status, f.order_details, f.menu_items, AS_OF)


@register("food_share", oracle=closed_form.share("category", closed_form.mix("category", False, True, False)))
def q_food_share(spark, sf):
    f = fx(spark, sf)
    return daily.with_share(daily.food_mix(f.orders_status, f.order_details, f.menu_items, AS_OF))


@register("drink_share", oracle=closed_form.share("name", closed_form.mix("name", True, True, False)))
def q_drink_share(spark, sf):
    f = fx(spark, sf)
    return daily.with_share(daily.drink_mix(f.orders_status, f.order_details, f.menu_items, AS_OF))


@register("food_revenue_literal", oracle=closed_form.mix("category", False, False, True), headline=True)
def q_food_revenue_literal(spark, sf):
    f = fx(spark, sf)
    return daily.food_revenue(f.orders_status, f.order_details, f.menu_items, AS_OF, status=None)


@register("drink_revenue_literal", oracle=closed_form.mix("name", True, False, True))
def q_drink_revenue_literal(spark, sf):
    f = fx(spark, sf)
    return daily.drink_revenue(f.orders_status, f.order_details, f.menu_items, AS_OF, status=None)


@register("food_revenue", oracle=closed_form.mix("category", False, True, True))
def q_food_revenue(spark, sf):
    f = fx(spark, sf)
    return daily.food_revenue(f.orders_status, f.order_details, f.menu_items, AS_OF, status="pending")


@register("drink_revenue", oracle=closed_form.mix("name", True, True, True))
def q_drink_revenue(spark, sf):
    f = fx(spark, sf)
    return daily.drink_revenue(f.orders_status, f.order_details, f.menu_items, AS_OF, status="pending")


@register("orders_by_slot", oracle="""
WITH slots AS (
  SELECT TIMESTAMP '1998-06-15 00:00:00' + CAST(k AS INTEGER) * INTERVAL 15 MINUTE AS slot_start
  FROM range(96) t(k))
SELECT slot_start AS time_window, count(e.order_id) AS num_orders
FROM slots LEFT JOIN f_orders_status e
  ON e.status = 'pending' AND e.event_timestamp >= slot_start
 AND e.event_timestamp < slot_start + INTERVAL 15 MINUTE
GROUP BY slot_start
""", headline=True)
def q_orders_by_slot(spark, sf):
    return daily.orders_by_slot(fx(spark, sf).orders_status, AS_OF)


def _delay_sql(status: str) -> str:
    return f"""
WITH pend AS (SELECT order_id, event_timestamp AS t0 FROM f_orders_status WHERE status = 'pending'),
tgt AS (SELECT order_id, event_timestamp AS t1 FROM f_orders_status
        WHERE status = '{status}' AND CAST(event_timestamp AS DATE) = {DAY}),
pairs AS (SELECT sum(epoch_us(t1) - epoch_us(t0)) AS num, count(*) AS den
          FROM tgt JOIN pend ON pend.order_id = tgt.order_id),
y AS (SELECT CAST(num AS DOUBLE) / den / 1e6 AS s FROM pairs)
SELECT round(s, 6) AS avg_seconds,
       CAST(CAST(floor(coalesce(s, 0.0) / 60) AS BIGINT) AS VARCHAR) || '''' ||
       CAST(CAST(floor(coalesce(s, 0.0) - 60 * floor(coalesce(s, 0.0) / 60)) AS BIGINT) AS VARCHAR) || '''''' AS avg_label
FROM y"""


#: Days between an order and its answers at most (both come within the hour here): older days are not scanned.
DELAY_LOOKBACK_DAYS = 1


@register("avg_accept", oracle=_delay_sql("accepted"))
def q_avg_accept(spark, sf):
    return daily.avg_delay(fx(spark, sf).orders_status, AS_OF, "accepted", DELAY_LOOKBACK_DAYS)


@register("avg_complete", oracle=_delay_sql("completed"))
def q_avg_complete(spark, sf):
    return daily.avg_delay(fx(spark, sf).orders_status, AS_OF, "completed", DELAY_LOOKBACK_DAYS)


# -- history (F) -------------------------------------------------------------
@register("yearly_orders", oracle=closed_form.YEARLY_ORDERS, headline=True)
def q_yearly_orders(spark, sf):
    return history.yearly_orders(fx(spark, sf).orders_status, YEAR)


@register("yearly_revenue", oracle=closed_form.YEARLY_REVENUE)
def q_yearly_revenue(spark, sf):
    f = fx(spark, sf)
    return history.yearly_revenue(f.orders_status, f.orders, YEAR)


@register("region_orders", oracle=closed_form.REGION_ORDERS)
def q_region_orders(spark, sf):
    f = fx(spark, sf)
    return history.region_orders(f.orders_status, f.orders, YEAR)


@register("year_bounds", oracle=closed_form.YEAR_BOUNDS)
def q_year_bounds(spark, sf):
    return history.year_bounds(fx(spark, sf).orders_status)


@register("year_list", oracle=closed_form.YEAR_LIST)
def q_year_list(spark, sf):
    return history.year_list(fx(spark, sf).orders_status)


@register("yearly_summary", oracle=closed_form.YEARLY_SUMMARY)
def q_yearly_summary(spark, sf):
    f = fx(spark, sf)
    return history.yearly_summary(f.orders_status, f.orders, YEAR)


# -- riders (G) --------------------------------------------------------------

@register("n_riders", oracle="SELECT COUNT(DISTINCT rider_id) AS n_riders FROM f_roster")
def q_n_riders(spark, sf):
    return riders.n_riders(fx(spark, sf).roster)


@register("riders_list", oracle="SELECT rider_id, name FROM f_roster")
def q_riders_list(spark, sf):
    return riders.riders_list(fx(spark, sf).roster)


@register("rider_by_name", oracle=f"SELECT MIN(rider_id) AS rider_id FROM f_roster WHERE name = '{RIDER_NAME}'")
def q_rider_by_name(spark, sf):
    return riders.rider_id_by_name(fx(spark, sf).roster, RIDER_NAME)


@register("rider_status_matrix", oracle=closed_form.RIDER_STATUS_MATRIX, headline=True)
def q_rider_status_matrix(spark, sf):
    f = fx(spark, sf)
    return riders.rider_status_matrix(f.orders_status, f.roster, AS_OF)


@register("rider_daily", oracle=closed_form.rider_daily(RIDER), headline=True)
def q_rider_daily(spark, sf):
    start, end = riders.month_to_date(AS_OF)  # G6: first of the month .. reporting day
    return riders.rider_daily(fx(spark, sf).orders_status, RIDER, start, end)


@register("rider_daily_long", oracle=closed_form.rider_daily_long(RIDER))
def q_rider_daily_long(spark, sf):
    start, end = riders.month_to_date(AS_OF)
    return riders.rider_daily_long(riders.rider_daily(fx(spark, sf).orders_status, RIDER, start, end))


# -- menu (A2-A4, H) -----------------------------------------------------------

@register("menu_full", oracle="SELECT * FROM f_menu_items")
def q_menu_full(spark, sf):
    return menu.menu_full(fx(spark, sf).menu_items)


@register("menu_listing", oracle="SELECT item_id, name, category FROM f_menu_items")
def q_menu_listing(spark, sf):
    return menu.menu_listing(fx(spark, sf).menu_items)


@register("menu_by_kind", oracle="""
SELECT item_id, name, category, CASE WHEN category = 'Drink' THEN 'drink' ELSE 'food' END AS kind
FROM f_menu_items
""")
def q_menu_by_kind(spark, sf):
    return menu.menu_by_kind(fx(spark, sf).menu_items)


@register("category_counts", oracle="""
SELECT category, COUNT(*) AS count FROM f_menu_items WHERE category IS NOT NULL GROUP BY category
""")
def q_category_counts(spark, sf):
    return menu.category_counts(fx(spark, sf).menu_items)


@register("category_share", oracle="""
SELECT category, COUNT(*) AS count, round(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS share
FROM f_menu_items WHERE category IS NOT NULL GROUP BY category
""")
def q_category_share(spark, sf):
    """Each category's share of the menu, NULL categories dropped."""
    return share_of_total(menu.category_counts(fx(spark, sf).menu_items), "count")


@register("append_menu", oracle="""
SELECT item_id, name, description, price, category,
       CASE WHEN item_id % 5 = 0 THEN DATE '1998-06-15' ELSE date_added END AS date_added
FROM f_menu_items
""")
def q_append_menu(spark, sf):
    """Every fifth part arrives as a new item without a date and is appended to the menu of the others."""
    items = fx(spark, sf).menu_items
    new = items.filter(F.col("item_id") % 5 == 0).drop("date_added")
    return menu_ingest.append_menu(items.filter(F.col("item_id") % 5 != 0), new, AS_OF)


@register("price_counts", oracle="SELECT price, COUNT(*) AS count FROM f_menu_items GROUP BY price")
def q_price_counts(spark, sf):
    return menu.price_counts(fx(spark, sf).menu_items)


@register("price_density", oracle="""
WITH p AS (SELECT CAST(price AS DOUBLE) AS x FROM f_menu_items WHERE price IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi, COUNT(*) AS n,
             stddev_samp(x) * pow(CAST(COUNT(*) AS DOUBLE), -0.2) AS h FROM p),
g AS (SELECT CAST(k AS INTEGER) AS point, lo + (k * (hi - lo)) / 500 AS gx FROM s, range(500) t(k)),
d AS (SELECT x, COUNT(*) AS c FROM p GROUP BY x)
SELECT point, round(gx, 6) AS x,
       round(SUM(c * exp(-0.5 * ((gx - d.x) / s.h) * ((gx - d.x) / s.h))) / (s.n * s.h * sqrt(2 * pi())), 6) AS density
FROM g, d, s GROUP BY point, gx, s.n, s.h
""", headline=True)
def q_price_density(spark, sf):
    return menu.price_density(fx(spark, sf).menu_items)
