"""Source, legacy-order and position queries (A, I, J) in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.operators import legacy, positions
from orderflow.plans.catalog import fx, register
from orderflow.session import scratch_path
from orderflow.sources import geojson, messages


def confirmed_messages(f):
    """Confirmed-order messages derived from the legacy orders.

    Odd ids are written by an older producer that names the field ``user``
    instead of ``username`` (T22); NULL fields are left out of the JSON.
    """
    lg = f.legacy_orders
    odd = F.col("id").cast("bigint") % 2 == 1
    body = F.struct("id",
                    F.when(~odd, F.col("username")).alias("username"),
                    F.when(odd, F.col("username")).alias("user"),
                    "email", "food", "size", "cost", "time", "order_completed")
    return lg.select(F.lit("order_confirmed").alias("topic"), F.to_json(body).alias("value"))


def completed_messages(f):
    lg = f.legacy_orders.filter(F.col("order_completed") == 1)
    body = F.struct(F.col("id").cast("bigint").alias("order_id"), F.col("email").alias("email_id"))
    return lg.select(F.lit("order_completed").alias("topic"), F.to_json(body).alias("value"))


@register("parse_confirmed", oracle="SELECT * FROM f_legacy_orders")
def q_parse_confirmed(spark, sf):
    return messages.parse_confirmed(confirmed_messages(fx(spark, sf)))


@register("orders_to_json", oracle="""
WITH info AS (
  SELECT order_id,
         '{' || string_agg('"' || CAST(item_id AS VARCHAR) || '":' || coalesce(CAST(quantity AS VARCHAR), 'null'), ','
                           ORDER BY CAST(item_id AS VARCHAR)) || '}' AS m
  FROM f_request_lines GROUP BY order_id)
SELECT CAST(q.order_id AS VARCHAR) AS key,
       '{"order_id":' || CAST(q.order_id AS VARCHAR) || ',"email":"' || q.email
       || '","phone_number":"' || q.phone_number || '","city":"' || q.city
       || '","order_created_timestamp":"' || strftime(q.order_created_timestamp, '%Y-%m-%dT%H:%M:%S.%g') || '"'
       || coalesce(',"order_info":' || info.m, '') || '}' AS value
FROM f_requests q LEFT JOIN info ON q.order_id = info.order_id
""")
def q_orders_to_json(spark, sf):
    f = fx(spark, sf)
    return messages.to_messages(f.order_requests, "order_id")


@register("route_by_topic", oracle="""
SELECT 'order_confirmed' AS topic, id AS order_id, email FROM f_legacy_orders
UNION ALL
SELECT 'order_completed', id, email FROM f_legacy_orders WHERE order_completed = 1
""")
def q_route_by_topic(spark, sf):
    f = fx(spark, sf)
    return messages.route_by_topic(confirmed_messages(f).unionByName(completed_messages(f)))


@register("route_points", oracle="""
SELECT busline, CAST(event_id // 1000 AS BIGINT) AS block,
       CAST(ROW_NUMBER() OVER (PARTITION BY busline, event_id // 1000 ORDER BY position_ts, event_id) - 1 AS INTEGER) AS point,
       latitude, longitude
FROM f_positions
""")
def q_route_points(spark, sf):
    """GeoJSON route documents are derived from the position table, written
    one document per line, read back with the explicit GeoJSON schema and
    exploded to vertices."""
    f = fx(spark, sf)
    path = scratch_path(spark, "routes")
    geojson.routes_from_positions(f.positions).select("doc").write.mode("overwrite").text(path)
    geo = geojson.read_route(spark, path, multi_line=False)
    return geojson.feature_points(geo).select(
        F.col("properties")["busline"].alias("busline"), F.col("properties")["block"].cast("bigint").alias("block"),
        "point", "latitude", "longitude")


@register("last_orders", oracle="SELECT * FROM f_legacy_orders ORDER BY time DESC NULLS FIRST, id LIMIT 20",
          headline=True)
def q_last_orders(spark, sf):
    return legacy.last_orders(fx(spark, sf).legacy_orders)


@register("legacy_totals", oracle="""
SELECT COUNT(CASE WHEN order_completed = 0 THEN 1 END) AS active_orders, COUNT(*) AS order_count,
       CAST(coalesce(SUM(cost), 0) AS BIGINT) AS total_revenue
FROM f_legacy_orders
""")
def q_legacy_totals(spark, sf):
    return legacy.legacy_totals(fx(spark, sf).legacy_orders)


@register("transaction_lines", oracle="""
SELECT id, 'Order by: ' || username || ': ' || food || ' (size ' || size || '). Cost: ' || CAST(cost AS VARCHAR)
           || '. Order time: ' || strftime(time, '%Y-%m-%d %H:%M:%S') AS line
FROM f_legacy_orders
""")
def q_transaction_lines(spark, sf):
    return legacy.transaction_lines(fx(spark, sf).legacy_orders)


@register("unique_emails", oracle="SELECT COUNT(DISTINCT email) AS n_unique_emails FROM f_legacy_orders")
def q_unique_emails(spark, sf):
    return legacy.unique_emails(fx(spark, sf).legacy_orders)


@register("latest_positions", oracle="""
SELECT busline, event_id, position_ts, latitude, longitude FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY busline ORDER BY position_ts DESC, event_id DESC) AS rn
  FROM f_positions WHERE busline IN ('00001', '00002', '00003')) x
WHERE rn = 1
""", headline=True)
def q_latest_positions(spark, sf):
    return positions.latest_positions(fx(spark, sf).positions)
