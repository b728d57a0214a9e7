"""Sources: GeoJSON routes, message round trips, legacy and position operators."""

import json
import os

from pyspark.sql import functions as F

from orderflow.operators import daily, legacy, lifecycle, positions
from orderflow.plans import catalog, feeds
from orderflow.session import scratch_path
from orderflow.sources import geojson, messages
from tests.conftest import SF_SMALL
from tests.helpers import rows


def test_read_pretty_geojson_two_points(spark):
    # A pretty-printed FeatureCollection like the original route file.
    path = scratch_path(spark, "route")
    os.makedirs(path)
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {},
           "geometry": {"type": "LineString", "coordinates": [[7.25, 46.5], [7.5, 46.75]]}}]}
    with open(os.path.join(path, "route.json"), "w") as fh:
        json.dump(doc, fh, indent=2)
    pts = geojson.route_points(geojson.read_route(spark, path, multi_line=True))
    assert rows(pts) == [(0, 0, 46.5, 7.25), (0, 1, 46.75, 7.5)]


def test_confirmed_messages_round_trip_with_user_alias(spark):
    f = catalog.fx(spark, SF_SMALL)
    msgs = feeds.confirmed_messages(f)
    assert msgs.filter(F.col("value").contains('"user":')).count() > 0      # old producer field
    parsed = messages.parse_confirmed(msgs)
    assert parsed.exceptAll(f.legacy_orders).count() == 0
    assert f.legacy_orders.exceptAll(parsed).count() == 0


def test_order_messages_round_trip(spark):
    f = catalog.fx(spark, SF_SMALL)
    m = messages.parse_order_messages(messages.to_messages(f.order_requests, "order_id"))
    back = m.select("order_id", "email", "phone_number", "city", "order_info")
    orig = f.order_requests.select("order_id", "email", "phone_number", "city", "order_info")
    got = {r["order_id"]: r["order_info"] for r in back.collect()}
    want = {r["order_id"]: r["order_info"] for r in orig.collect()}
    assert got == want


def test_outcomes_partition_orders(spark):
    f = catalog.fx(spark, SF_SMALL)
    out = lifecycle.order_outcomes(f.orders_status, 3)
    assert out.count() == out.select("order_id").distinct().count() == f.orders.count()
    kinds = {r["outcome"] for r in out.select("outcome").distinct().collect()}
    assert kinds <= {"pending", "accepted", "failed", "completed"}


def test_shares_sum_to_one_on_fixture(spark):
    f = catalog.fx(spark, SF_SMALL)
    sh = daily.with_share(daily.drink_mix(f.orders_status, f.order_details, f.menu_items, catalog.AS_OF))
    assert abs(sh.agg(F.sum("share")).first()[0] - 1.0) < 1e-4


def test_last_orders_is_top_k(spark):
    f = catalog.fx(spark, SF_SMALL)
    top = legacy.last_orders(f.legacy_orders, 5).collect()
    allr = sorted(f.legacy_orders.collect(), key=lambda r: (-r["time"].timestamp(), r["id"]))[:5]
    assert [r["id"] for r in top] == [r["id"] for r in allr]


def test_latest_positions_includes_only_known_lines(spark):
    f = catalog.fx(spark, SF_SMALL)
    out = positions.latest_positions(f.positions)
    assert {r["busline"] for r in out.collect()} <= {"00001", "00002", "00003"}
    every = positions.latest_positions(f.positions, lines=None)
    assert every.count() == f.positions.select("busline").distinct().count()


def test_unique_emails_exact_and_sketch(spark):
    f = catalog.fx(spark, SF_SMALL)
    exact = legacy.unique_emails(f.legacy_orders).first()[0]
    approx = legacy.unique_emails(f.legacy_orders, approx=True).first()[0]
    assert exact == 150 and abs(approx - exact) <= 0.05 * exact
