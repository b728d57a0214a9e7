"""Order ingest: validation, quarantine, upsert, totals."""

import datetime as dt
from decimal import Decimal

from orderflow import schemas
from orderflow.operators import ingest
from orderflow.plans import catalog
from tests.conftest import SF_SMALL
from tests.helpers import rows, seed_menu


def _requests(spark, items):
    data = [(oid, email, phone, {k: v for k, v in info.items()} if info is not None else None, city,
             dt.datetime(2024, 1, 1, 10, oid))
            for oid, email, phone, info, city in items]
    return spark.createDataFrame(data, "order_id long, email string, phone_number string, "
                                       "order_info map<string,int>, city string, order_created_timestamp timestamp_ntz")


def test_validation_and_quarantine(spark):
    req = _requests(spark, [
        (1, "a@x", "1", {"1": 2, "9": 1}, "Rome"),      # ok: 2 x 9.99 + 3.50
        (2, "", "1", {"1": 1}, "Rome"),                # empty e-mail
        (3, "b@x", "1", {}, "Rome"),                   # empty map
        (4, "b@x", "1", None, "Rome"),                 # no map
        (5, "c@x", "1", {"1": 1, "77": 1}, "Rome"),    # unknown item -> whole order lost
        (6, "c@x", "1", {"1": None}, "Rome"),          # null quantity
        (7, "d@x", " ", {"x": 1}, "Rome"),             # non-numeric key -> unknown item
    ])
    ok, lines, rej = ingest.split_requests(req, seed_menu(spark))
    assert rows(rej) == [(2, "invalid_request"), (3, "invalid_request"), (4, "invalid_request"),
                         (5, "unknown_item"), (6, "null_quantity"), (7, "unknown_item")]
    assert rows(ok, "order_id") == [(1,)]
    assert rows(ingest.order_totals(lines)) == [(1, Decimal("23.48"))]


def test_upsert_first_writer_wins(spark):
    existing = spark.createDataFrame([(10, "old@x", "0", "Milan", dt.date(2023, 1, 1))], schemas.USERS)
    req = spark.createDataFrame([
        (5, "new@x", "111", "Rome", dt.datetime(2024, 1, 2)),
        (3, "new@x", "222", "Turin", dt.datetime(2024, 1, 1)),
        (4, "old@x", "999", "Naples", dt.datetime(2024, 1, 1)),
    ], "order_id long, email string, phone_number string, city string, order_created_timestamp timestamp_ntz")
    out = rows(ingest.upsert_users(existing, req))
    assert out == [(10, "old@x", "0", "Milan", dt.date(2023, 1, 1)),
                   (14, "new@x", "222", "Turin", dt.date(2024, 1, 1))]


def test_ingested_plus_rejected_is_requested(spark):
    f = catalog.fx(spark, SF_SMALL)
    ok, lines, rej = ingest.split_requests(f.order_requests, f.menu_items)
    assert ok.count() + rej.count() == f.requests.count() == 1500
    assert rej.count() == 73


def test_overlay_and_append(spark):
    orders = spark.createDataFrame([(1, "pending"), (2, "pending")], "order_id long, status string")
    upd = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), 1), (1, "b", dt.datetime(2024, 1, 2), 2)],
                                "order_id long, status string, event_timestamp timestamp_ntz, response_id long")
    assert rows(ingest.overlay_status(orders, upd), "order_id", "status") == [(1, "b"), (2, "pending")]
    items = spark.createDataFrame([(99, "Tiramisu", None, Decimal("5.00"), "Dessert", None)], schemas.MENU_ITEMS)
    out = ingest.append_menu(seed_menu(spark), items, dt.date(2024, 5, 1))
    assert out.count() == 11
    assert out.filter("item_id = 99").first()["date_added"] == dt.date(2024, 5, 1)


def test_anomaly_checks(spark):
    from tests.helpers import events_df
    ev = events_df(spark, [(1, "denied", 1, "2024-01-01 10:00:00"), (1, "denied", 1, "2024-01-01 10:05:00"),
                           (1, "accepted", 2, "2024-01-01 10:01:00"), (2, "accepted", 1, "2024-01-01 10:00:00")])
    assert rows(ingest.repeat_denials(ev)) == [(1, 1, 2)]
    assert rows(ingest.accept_before_deny(ev), "order_id") == [(1,)]


def test_pipeline_outputs_agree_with_single_queries(spark):
    f = catalog.fx(spark, SF_SMALL)
    out = ingest.ingest_pipeline(f.requests, f.menu_items, f.users_existing, lines=f.request_lines)
    ok, lines, rej = ingest.split_requests(f.requests, f.menu_items, lines=f.request_lines)
    assert out["rejected"].count() == rej.count() == 73
    assert out["orders"].count() == ok.count() == out["orders_status"].count()
    assert out["order_details"].count() == lines.count()


def test_lines_are_scanned_and_priced_once(spark, tmp_path):
    f = catalog.fx(spark, SF_SMALL)
    path = str(tmp_path / "lines")
    f.request_lines.write.parquet(path)
    source = spark.read.parquet(path)
    twice = ingest.split_requests(f.requests, f.menu_items, lines=source)
    once = ingest.split_requests(f.requests, f.menu_items, lines=source, price_once=True)
    # after the one pass that wrote them, no output reads the line source again
    for mine, plain in zip(once, twice, strict=True):
        assert not any(path in name for name in mine.inputFiles())
        assert sorted(mine.collect(), key=str) == sorted(plain.collect(), key=str)
    assert any(path in name for name in twice[1].inputFiles())


def test_headers_meet_orders_not_lines(spark):
    head = "order_id long, email string, phone_number string, city string, order_created_timestamp timestamp_ntz"
    at = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([(k, "a@x", "1", "Rome", at) for k in (1, 2, 3, 4)], head)
    lines = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (2, None, 1), (4, 1, 1), (4, None, None), (9, 1, 1)],
                                  "order_id long, item_id long, quantity int")
    ok, kept, rej = ingest.split_requests(req, seed_menu(spark), lines=lines, price_once=True)
    # repeated lines count twice; a line without item is none; order 3 has no line; lines of no request are left out
    assert rows(ok, "order_id", "total_amount") == [(1, Decimal("39.96")), (4, Decimal("9.99"))]
    assert rows(rej) == [(2, "invalid_request"), (3, "invalid_request")]
    assert kept.filter("order_id = 1").count() == 2 and kept.filter("order_id = 9").isEmpty()


def test_empty_ingest(spark):
    req, menu = _requests(spark, []), seed_menu(spark)
    for once in (False, True):
        assert all(part.isEmpty() for part in ingest.split_requests(req, menu, price_once=once))
