"""Per-day partials: equal to the queries over the whole log, late days derived anew, days pruned."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from orderflow.operators import daily, history
from orderflow.operators import history_days as days
from orderflow.session import list_folder, scratch_path
from tests.helpers import events_df, rows

DAY = dt.date(2024, 3, 5)


def some_events(seed, n=300):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = dt.datetime(2023, 12, 25) + dt.timedelta(days=r.choice([0, 8, 9, 71, 72, 400]), seconds=r.randrange(86400))
        out.append((r.randrange(30), r.choice(["pending", "pending", "accepted", "denied", "completed", None]), None, str(t)))
    return out


@pytest.fixture(scope="module")
def orders(spark):
    # order 29 is unknown, order 3 has no city, order 4 no total
    return spark.createDataFrame([(i, None if i == 3 else f"c{i % 4}", None if i == 4 else Decimal(i) / 4) for i in range(29)],
                                 "order_id bigint, delivery_city string, total_amount decimal(10,2)")


def check(spark, kept, log, orders):
    counts, delays = kept.counts(spark), kept.delays(spark)
    for year in (2023, 2024):
        assert rows(days.yearly_orders(counts, year)) == rows(history.yearly_orders(log, year))
        assert set(rows(days.yearly_revenue(counts, year))) == set(rows(history.yearly_revenue(log, orders, year)))
        for status in ("pending", None):
            assert (set(map(tuple, days.region_orders(counts, year, status).collect()))
                    == set(map(tuple, history.region_orders(log, orders, year, status).collect())))
        assert (set(map(tuple, days.yearly_summary(counts, year).collect()))
                == set(map(tuple, history.yearly_summary(log, orders, year).collect())))
    assert days.year_bounds(counts).collect() == history.year_bounds(log).collect()
    for day, status in ((DAY, "accepted"), (DAY, "completed"), (dt.date(2024, 1, 2), "accepted")):
        assert days.avg_delay(delays, day, status).collect() == daily.avg_delay(log, day, status).collect()


def test_partials_equal_the_log_and_late_rows_are_derived(spark, orders):
    first, late = some_events(1), some_events(2, 25)
    kept = days.DayHistory(scratch_path(spark, "days"))
    log = events_df(spark, first)
    kept.refresh(log, orders)
    arrived, log = events_df(spark, late), events_df(spark, first + late)
    for _ in range(2):  # again, as after a failure
        kept.refresh(log, orders, days.touched_days(arrived))
    check(spark, kept, log, orders)


def test_late_pending_row_changes_the_day_of_its_answer(spark, orders):
    first = [(1, "pending", None, "2024-03-04 10:00:00"), (1, "accepted", 5, "2024-03-05 10:00:00")]
    kept = days.DayHistory(scratch_path(spark, "days"))
    kept.refresh(events_df(spark, first), orders)
    late = [(1, "pending", None, "2024-03-03 10:00:00")]
    log = events_df(spark, first + late)
    assert rows(days.delay_days(log, days.touched_days(events_df(spark, late)))) == [(dt.date(2024, 3, 3),), (DAY,)]
    kept.refresh(log, orders, days.touched_days(events_df(spark, late)))
    assert days.avg_delay(kept.delays(spark), DAY, "accepted").first().avg_seconds == 1.5 * 86400


def test_a_day_whose_rows_are_gone_counts_nothing(spark, orders):
    kept = days.DayHistory(scratch_path(spark, "days"))
    log = events_df(spark, [(1, "pending", None, "2024-03-04 10:00:00"), (1, "accepted", 5, "2024-03-05 10:00:00")])
    kept.refresh(log, orders)
    rest = log.where("status = 'pending'")
    kept.refresh(rest, orders, days.touched_days(log))
    assert rows(days.region_orders(kept.counts(spark), 2024, None)) == [(3, "c1", 1)]
    assert kept.delays(spark).count() == 0


def test_empty_log_and_history_never_built(spark, orders):
    kept = days.DayHistory(scratch_path(spark, "days"))
    log = events_df(spark, [])
    kept.refresh(log, orders)
    check(spark, kept, log, orders)


def test_one_file_a_day_and_days_pruned(spark, orders):
    kept = days.DayHistory(scratch_path(spark, "days"))
    kept.refresh(events_df(spark, some_events(3)), orders)
    for name in list_folder(spark, f"{kept.path}/counts"):
        if name.startswith("event_date="):
            assert sum(f.endswith(".parquet") for f in list_folder(spark, f"{kept.path}/counts/{name}")) == 1
    plan = days.yearly_orders(kept.counts(spark), 2024)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2024-01-01" in plan
