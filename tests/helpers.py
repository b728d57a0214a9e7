"""Small helpers shared by the tests."""

from __future__ import annotations

import datetime as dt


from orderflow import schemas


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def events_df(spark, rows):
    """rows: (order_id, status, rider_id, 'YYYY-MM-DD HH:MM:SS')"""
    return spark.createDataFrame([(o, s, r, ts(t)) for o, s, r, t in rows], schemas.ORDERS_STATUS)


RESP_SCHEMA = schemas.RIDER_RESPONSE


def responses_df(spark, rows):
    """rows: (response_id, order_id, rider_id, status, 'YYYY-MM-DD HH:MM:SS')"""
    return spark.createDataFrame([(i, o, r, s, ts(t)) for i, o, r, s, t in rows], RESP_SCHEMA)


def seed_riders(spark):
    return spark.createDataFrame([(r[0], r[1]) for r in schemas.SEED_RIDERS], "rider_id int, name string")


def seed_menu(spark):
    from decimal import Decimal
    rows = [(i + 1, n, d, Decimal(p).quantize(Decimal("0.01")), c, dt.date(2024, 1, 1))
            for i, (n, d, p, c) in enumerate(schemas.SEED_MENU)]
    return spark.createDataFrame(rows, schemas.MENU_ITEMS)


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
