"""The streaming gates over an event table that is a folder, in several micro-batches of time order."""

import pytest
from pyspark.sql import functions as F

from orderflow.operators import lifecycle
from orderflow.plans import catalog, streams
from orderflow.session import scratch_path
from orderflow.streaming import events_stream, run_available_now
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def folder_sf(spark):
    """The small tables with events as a folder of files in no time order."""
    sf = scratch_path(spark, "folder-sf")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        df.repartition(5, F.rand(1)).write.parquet(f"{sf}/{t}.parquet")
    return sf


def test_events_stream_reads_a_file_or_a_folder(spark, folder_sf):
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert run_available_now(events_stream(spark, SF_SMALL), "events").count() == n > 0
    assert run_available_now(events_stream(spark, folder_sf, max_files=2), "events").count() == n


@pytest.mark.parametrize("name", ["gate_stream", "gate_stream_table"])
def test_gate_streams_of_a_folder(spark, folder_sf, name, monkeypatch):
    batches = []
    run = streams.run_available_now

    def counted(stream, *args, **kwargs):
        batches.append(stream)
        return run(stream, *args, **kwargs)

    monkeypatch.setattr(streams, "run_available_now", counted)
    f = catalog.fx(spark, folder_sf)
    want = sorted(r.response_id for r in lifecycle.admit_responses(f.responses_of(f.table("events")), catalog.N).collect())
    got = catalog.REGISTRY[name](spark, folder_sf)
    assert sorted(r.response_id for r in got.collect()) == want and want
    # one query over a shuffled feed, or one run for each range of time
    assert len(batches) == {"gate_stream": 1, "gate_stream_table": streams.MICRO_BATCHES}[name]
    one_file = catalog.REGISTRY[name](spark, SF_SMALL)
    assert sorted(map(tuple, one_file.collect())) == sorted(map(tuple, got.collect()))


def test_hot_order_is_read_in_portions(spark):
    """A frame larger than one Arrow batch equals the batch gate, whatever the order of its rows."""
    import datetime as dt

    from orderflow import schemas
    from orderflow.streaming import gate_stream, table_stream
    from tests.helpers import responses_df
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, i % 2, "denied" if i < 900 else ("accepted", "denied")[i % 3 > 0],
             (t0 + dt.timedelta(minutes=i)).isoformat(sep=" ")) for i in range(1500)]
    df = responses_df(spark, rows)
    path = scratch_path(spark, "hot")
    df.orderBy(F.col("response_id").desc()).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        s = table_stream(spark, path, schemas.RIDER_RESPONSE, ts_cols=("event_timestamp",))
        got = sorted(r.response_id for r in run_available_now(gate_stream(s, 3), "hot-out").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(r.response_id for r in lifecycle.admit_responses(df, 3).collect())
    assert len(got) == 901
