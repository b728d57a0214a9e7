"""Decision gate: batch cut-off == sequential loop == streaming state."""

import datetime as dt

from hypothesis import given, settings, HealthCheck, strategies as st

from orderflow.operators import lifecycle
from orderflow.session import scratch_path
from orderflow.streaming import gate_stream, run_available_now, table_stream
from orderflow import schemas
from pyspark.sql import functions as F
from tests.helpers import events_df, responses_df

T0 = dt.datetime(2024, 1, 1)


def sequential(resp, n, log=()):
    """The gate as the original runs it, one response at a time (serialised)."""
    acc, den = {}, {}
    for o, s, r in log:
        if r is None:
            continue
        (acc if s == "accepted" else den).setdefault(o, set()).add(r) if s in ("accepted", "denied") else None
    out = []
    for rid, o, r, s, t in sorted(resp, key=lambda x: (x[1], x[4], x[0])):
        a, d = acc.setdefault(o, set()), den.setdefault(o, set())
        if len(a) >= 1 or len(d) >= n:
            continue
        out.append(rid)
        (a if s == "accepted" else d).add(r)
    return sorted(out)


response_lists = st.lists(
    st.tuples(st.integers(0, 3), st.integers(1, 4), st.sampled_from(["accepted", "denied", "denied"]),
              st.integers(0, 6)),
    min_size=1, max_size=30)


def _rows(gen):
    return [(i, o, r, s, (T0 + dt.timedelta(minutes=m)).isoformat(sep=" ")) for i, (o, r, s, m) in enumerate(gen)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(gen=response_lists)
def test_batch_gate_equals_sequential(spark, gen):
    rows = _rows(gen)
    df = responses_df(spark, rows)
    got = sorted(r["response_id"] for r in lifecycle.admit_responses(df, 3).collect())
    want = sequential([(i, o, r, s, t) for i, o, r, s, t in rows], 3)
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(gen=response_lists, log=st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["accepted", "denied", "pending"]),
                                                   st.integers(1, 4)), max_size=6))
def test_batch_gate_with_log_equals_sequential(spark, gen, log):
    rows = _rows(gen)
    df = responses_df(spark, rows)
    log_rows = [(o, s, None if s == "pending" else r, "2023-12-31 00:00:00") for o, s, r in log]
    lg = events_df(spark, log_rows) if log_rows else events_df(spark, [(99, "pending", None, "2023-12-31 00:00:00")])
    got = sorted(r["response_id"] for r in lifecycle.admit_responses(df, 3, log=lg).collect())
    want = sequential(rows, 3, [(o, s, r) for o, s, r, _ in log_rows])
    assert got == want


def test_gate_hand_case(spark):
    # order 1: two denials by rider 1, a denial by 2, then 3 denies -> quorum at the 3rd distinct rider;
    # order 2: accept closes immediately; the second acceptance is rejected (T6 fixed).
    rows = [(1, 1, 1, "denied", "2024-01-01 00:01:00"), (2, 1, 1, "denied", "2024-01-01 00:02:00"),
            (3, 1, 2, "denied", "2024-01-01 00:03:00"), (4, 1, 3, "denied", "2024-01-01 00:04:00"),
            (5, 1, 4, "accepted", "2024-01-01 00:05:00"),
            (6, 2, 2, "accepted", "2024-01-01 00:01:00"), (7, 2, 3, "accepted", "2024-01-01 00:01:00")]
    got = sorted(r["response_id"] for r in lifecycle.admit_responses(responses_df(spark, rows), 3).collect())
    assert got == [1, 2, 3, 4, 6]


def test_stream_gate_in_order_batches_equals_batch(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 9), rnd.randint(1, 4), rnd.choice(["accepted", "denied", "denied"]),
             (T0 + dt.timedelta(minutes=i)).isoformat(sep=" ")) for i in range(120)]
    df = responses_df(spark, rows)
    path = scratch_path(spark, "gate-in")
    for k in range(4):  # four time-ordered files -> four micro-batches
        df.filter((F.col("response_id") >= 30 * k) & (F.col("response_id") < 30 * (k + 1))) \
          .coalesce(1).write.mode("append").parquet(path)
    s = table_stream(spark, path, schemas.RIDER_RESPONSE, ts_cols=("event_timestamp",), max_files=1)
    out = run_available_now(gate_stream(s, 3), "gate-out")
    got = sorted(r["response_id"] for r in out.collect())
    assert got == sorted(r["response_id"] for r in lifecycle.admit_responses(df, 3).collect())
    assert got == sequential(rows, 3)


def test_table_state_gate_over_batches_equals_batch(spark):
    import random
    from orderflow.streaming.gate import gate_into_log
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 40), rnd.randint(1, 4), rnd.choice(["accepted", "denied", "denied", "denied"]),
             (T0 + dt.timedelta(minutes=i)).isoformat(sep=" ")) for i in range(160)]
    df = responses_df(spark, rows)
    path = scratch_path(spark, "gate-in")
    for k in range(4):
        df.filter((F.col("response_id") >= 40 * k) & (F.col("response_id") < 40 * (k + 1))) \
          .coalesce(1).write.mode("append").parquet(path)
    s = table_stream(spark, path, schemas.RIDER_RESPONSE, ts_cols=("event_timestamp",), max_files=1)
    log_path, ckpt = scratch_path(spark, "gate-log"), scratch_path(spark, "gate-ckpt")
    out = run_available_now(s, "g", out=log_path, checkpoint=ckpt, foreach_batch=gate_into_log(log_path, 3))
    assert out.select("epoch_id").distinct().count() >= 2  # several micro-batches admitted rows
    got = sorted(r["response_id"] for r in out.collect())
    assert got == sequential(rows, 3)
    # restart: nothing new, same log
    again = run_available_now(s, "g", out=log_path, checkpoint=ckpt, foreach_batch=gate_into_log(log_path, 3))
    assert sorted(r["response_id"] for r in again.collect()) == got
