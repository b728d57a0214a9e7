"""Date/time expressions shared by the operators.

Day and year filters are written as half-open ranges on the raw timestamp
column, never as ``to_date(ts) = d`` / ``year(ts) = y``: a range is a plain
comparison that parquet (and JDBC) can evaluate at the scan, while Catalyst
does not unwrap ``year()`` into a pushable predicate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ntz(value: dt.datetime | dt.date) -> Column:
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def day_start(as_of: dt.date) -> Column:
    return _ntz(as_of)


def day_range(as_of: dt.date) -> tuple[Column, Column]:
    return _ntz(as_of), _ntz(as_of + dt.timedelta(days=1))


def on_day(ts: Column | str, as_of: dt.date) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    lo, hi = day_range(as_of)
    return (ts >= lo) & (ts < hi)


def year_range(year: int) -> tuple[Column, Column]:
    return _ntz(dt.date(year, 1, 1)), _ntz(dt.date(year + 1, 1, 1))


def in_year(ts: Column | str, year: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    lo, hi = year_range(year)
    return (ts >= lo) & (ts < hi)


def month_start(as_of: dt.date) -> dt.date:
    return as_of.replace(day=1)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session TZ is UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def format_delay(seconds: Column) -> Column:
    """``M'S''`` label: whole minutes (floor) and the floored remainder seconds.

    NULL (no pairs) renders as ``0'0''``.
    """
    s = F.coalesce(seconds, F.lit(0.0))
    minutes = F.floor(s / 60)
    secs = F.floor(F.pmod(s, F.lit(60.0)))
    return F.concat(minutes.cast("string"), F.lit("'"), secs.cast("string"), F.lit("''"))


def day_slice(df, as_of: dt.date, ts: str = "event_timestamp"):
    """Rows of one day; also prunes ``event_date`` partitions when the log is laid out by day."""
    out = df.filter(on_day(ts, as_of))
    if "event_date" in df.columns:
        out = out.filter(F.col("event_date") == F.lit(as_of))
    return out


def range_slice(df, start: dt.date, end: dt.date, ts: str = "event_timestamp"):
    """Rows with ``start <= ts < end + 1 day``; prunes ``event_date`` partitions when present."""
    col = F.col(ts)
    out = df.filter((col >= _ntz(start)) & (col < _ntz(end + dt.timedelta(days=1))))
    if "event_date" in df.columns:
        out = out.filter((F.col("event_date") >= F.lit(start)) & (F.col("event_date") <= F.lit(end)))
    return out


def year_slice(df, year: int, ts: str = "event_timestamp"):
    """Rows of one year; prunes ``event_date`` partitions when present."""
    out = df.filter(in_year(ts, year))
    if "event_date" in df.columns:
        out = out.filter((F.col("event_date") >= F.lit(dt.date(year, 1, 1)))
                         & (F.col("event_date") < F.lit(dt.date(year + 1, 1, 1))))
    return out
