"""Streaming queries: each derives its feed from the tables, runs the stream
``availableNow`` into a checkpointed sink and returns the sink's content."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow import schemas
from orderflow.operators import legacy, lifecycle, positions
from orderflow.plans import dashboards, feeds, orderlog  # noqa: F401  (oracles reused below)
from orderflow.plans.catalog import AS_OF, N, ORACLE_RAW, fx, register
from orderflow.session import list_folder, scratch_path
from orderflow.sources import messages
from orderflow.sources.fixtures import positions_from
from orderflow.streaming import gate_event_time, run_available_now, table_stream
from orderflow.streaming.gate import gate_into_log
from orderflow.streaming.offsets import Consumer
from orderflow.streaming.live import kpi_row_writer, match_live, read_kpi_row, read_slots, slot_writer
from orderflow.streaming.sinks import append_batch
from orderflow.streaming.sketches import read_distinct, sketch_writer

#: A feed is replayed in this many micro-batches; each reads its share of the feed's files, however many those are.
MICRO_BATCHES = 4


def _files(spark) -> int:
    """Files of a derived feed: the session's shuffle partitions, so that write and read tasks grow with the job."""
    return max(MICRO_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _per_trigger(spark) -> int:
    return -(-_files(spark) // MICRO_BATCHES)


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def _write_feed(spark, values: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    values.select("value").repartition(_files(spark)).write.mode("overwrite").text(path)
    return path


def _log_stream(spark, f):
    """The status log, materialised as a table, replayed as a file stream."""
    path = scratch_path(spark, "status-log")
    f.orders_status.repartition(_files(spark)).write.mode("overwrite").parquet(path)
    return table_stream(spark, path, schemas.ORDERS_STATUS, ts_cols=("event_timestamp",), max_files=_per_trigger(spark))


def _event_stream(spark, f):
    """The event table, written as a feed of many files, replayed in several micro-batches (in no time order)."""
    path = scratch_path(spark, "event-feed")
    f.table("events").repartition(_files(spark)).write.parquet(path)
    return table_stream(spark, path, schemas.EVENTS, ts_cols=("ts",), max_files=_per_trigger(spark))


def _replay_in_time_order(spark, f, name: str, run) -> DataFrame:
    """Replay the event table in MICRO_BATCHES ranges of ``ts``, earliest first, through one checkpointed query.

    ``run(stream, out, checkpoint)`` is called once per range, with one sink and checkpoint, and processes it as one
    micro-batch: the state carries over, and no order of files or their times is relied on. Equal times share a
    range; rows without a time come last.
    """
    path, out = scratch_path(spark, "event-feed"), scratch_path(spark, name)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    shares = [k / MICRO_BATCHES for k in range(1, MICRO_BATCHES)]
    events = f.table("events")
    cuts = events.agg(F.percentile_approx(micros, shares).alias("cuts")).first().cuts or []
    part = sum((F.when(micros <= c, 0).otherwise(1) for c in cuts), F.lit(0))
    (events.withColumn("range", part).repartition(_files(spark))
     .write.partitionBy("range").parquet(path))
    ranges = sorted(n for n in list_folder(spark, path) if n.startswith("range="))
    for k in range(1, max(2, len(ranges) + 1)):  # an empty table has no range
        # by a pattern of the ranges so far: the source knows which files it has read
        feed = f"{path}/{{{','.join(ranges[:k])}}}" if ranges else path
        result = run(table_stream(spark, feed, schemas.EVENTS, ts_cols=("ts",)), out, out + "-checkpoint")
    return result


def slot_counts(events: DataFrame, minutes: int = 15, watermark: str | None = None) -> DataFrame:
    """Events per tumbling event-time window (streaming form of D10)."""
    if watermark:
        events = events.withWatermark("event_timestamp", watermark)
    return (events.groupBy(F.window("event_timestamp", f"{minutes} minutes"))
            .agg(F.count(F.lit(1)).alias("num_orders")))


def _confirmed_stream(spark, f):
    path = _write_feed(spark, feeds.confirmed_messages(f), "confirmed-feed")
    return messages.read_feed(spark, fmt="text", path=path, max_per_trigger=_per_trigger(spark))


@register("stream_orders", oracle="""
SELECT q.order_id, q.email, q.city, l.item_id, l.quantity
FROM f_requests q JOIN f_request_lines l ON q.order_id = l.order_id
""")
def q_stream_orders(spark, sf):
    """A5: order messages published as JSON (A8), consumed as a stream, exploded to lines."""
    f = fx(spark, sf)
    path = _write_feed(spark, messages.to_messages(f.order_requests, "order_id"), "order-feed")
    s = messages.parse_order_messages(messages.read_feed(spark, fmt="text", path=path, max_per_trigger=_per_trigger(spark)))
    lines = s.select("order_id", "email", "city", F.explode("order_info").alias("k", "quantity")).select(
        "order_id", "email", "city", F.col("k").try_cast("bigint").alias("item_id"), "quantity")
    return run_available_now(lines, "stream-orders")


@register("stream_append", oracle="SELECT * FROM f_legacy_orders")
def q_stream_append(spark, sf):
    """A6 + A7: confirmed messages -> parse -> per-batch idempotent append."""
    f = fx(spark, sf)
    parsed = messages.parse_confirmed(_confirmed_stream(spark, f))
    out = run_available_now(parsed, "stream-append", foreach_batch=append_batch)
    return out.select(*[c for c in out.columns if c != "epoch_id"])


@register("stream_route_by_topic", oracle=ORACLE_RAW["route_by_topic"])
def q_stream_route_by_topic(spark, sf):
    """One subscription over two topics, dispatched on the topic name."""
    f = fx(spark, sf)
    path = scratch_path(spark, "topics")
    both = feeds.confirmed_messages(f).unionByName(feeds.completed_messages(f))
    both.repartition(_files(spark)).write.partitionBy("topic").mode("overwrite").text(path)
    s = messages.read_feed(spark, fmt="text", path=path, max_per_trigger=_per_trigger(spark))
    return run_available_now(messages.route_by_topic(s), "stream-topics")


@register("stream_positions", oracle="""
SELECT busline, busline || '_' || CAST(event_id AS VARCHAR) AS key, position_ts, latitude, longitude
FROM f_positions
""")
def q_stream_positions(spark, sf):
    """A12 + J2: position messages keyed ``<line>_<id>``, parsed from a stream."""
    f = fx(spark, sf)
    p = f.positions
    msg = p.select(F.to_json(F.struct(
        "busline", messages.position_key(F.col("busline"), F.col("event_id")).alias("key"),
        F.date_format("position_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "latitude", "longitude")).alias("value"))
    path = _write_feed(spark, msg, "position-feed")
    s = messages.parse_positions(messages.read_feed(spark, fmt="text", path=path, max_per_trigger=_per_trigger(spark)))
    return run_available_now(s, "stream-positions")


@register("stream_slots", oracle="""
SELECT time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS window_start, COUNT(*) AS num_orders
FROM f_orders_status WHERE status = 'pending' GROUP BY 1
""")
def q_stream_slots(spark, sf):
    """D10 streaming: pending events per 15-minute tumbling window of event time.

    The replayed log is not in time order, so no watermark is set: a
    watermark would drop rows arriving behind it.  State is one counter per
    window (bounded by the time span, not by the event count) and the sink
    receives only the windows a micro-batch changed.  A live, time-ordered
    feed passes ``watermark`` to ``slot_counts`` to evict finished windows.
    """
    s = slot_counts(_log_stream(spark, fx(spark, sf)).filter(F.col("status") == "pending"))
    s = s.select(F.col("window.start").alias("window_start"), "num_orders")
    out = run_available_now(s, "stream-slots", mode="update", keys=["window_start"])
    return _ntz(out, "window_start")


@register("stream_daily_kpis", oracle="""
SELECT CAST(event_timestamp AS DATE) AS day,
       COUNT(CASE WHEN status = 'pending' THEN 1 END) AS total_orders,
       COUNT(CASE WHEN status = 'accepted' THEN 1 END) AS accepted_events,
       COUNT(CASE WHEN status = 'denied' THEN 1 END) AS denied_events,
       COUNT(CASE WHEN status = 'completed' THEN 1 END) AS completed_events
FROM f_orders_status GROUP BY 1
""")
def q_stream_daily_kpis(spark, sf):
    """Polling refresh replaced by incremental per-day counters over the event stream."""
    s = (_log_stream(spark, fx(spark, sf))
         .groupBy(F.to_date("event_timestamp").alias("day"))
         .agg(*[F.count(F.when(F.col("status") == st, 1)).alias(a) for st, a in
                (("pending", "total_orders"), ("accepted", "accepted_events"),
                 ("denied", "denied_events"), ("completed", "completed_events"))]))
    return run_available_now(s, "stream-daily", mode="update", keys=["day"])


@register("stream_totals", oracle=ORACLE_RAW["legacy_totals"])
def q_stream_totals(spark, sf):
    """Running active / count / revenue over the confirmed-order stream."""
    parsed = messages.parse_confirmed(_confirmed_stream(spark, fx(spark, sf)))
    return run_available_now(legacy.legacy_totals(parsed), "stream-totals", mode="complete")


@register("stream_unique_emails", oracle=ORACLE_RAW["unique_emails"])
def q_stream_unique_emails(spark, sf):
    """Distinct e-mails seen so far.

    ``dropDuplicates`` keeps the set of seen e-mails in the state store
    (partitioned by e-mail across the cluster); only first sightings reach
    the running count, and the sink receives a single row per batch.
    """
    parsed = messages.parse_confirmed(_confirmed_stream(spark, fx(spark, sf)))
    counts = parsed.dropDuplicates(["email"]).agg(F.count(F.lit(1)).alias("n_unique_emails"))
    return run_available_now(counts, "stream-emails", mode="complete")


@register("stream_unique_emails_sketch", oracle="""
SELECT COUNT(DISTINCT email) AS n_unique_emails, TRUE AS estimate_is_near FROM f_legacy_orders
""")
def q_stream_unique_emails_sketch(spark, sf):
    """I7 in bounded space: one sketch an epoch, merged on reading; held against the exact count within four standard errors."""
    f, out = fx(spark, sf), scratch_path(spark, "email-sketches")
    parsed, write = messages.parse_confirmed(_confirmed_stream(spark, f)), sketch_writer(out, "email", merge_after=2)
    run_available_now(parsed, "email-stream", foreach_batch=lambda df, epoch, _: write(df, epoch))
    exact = legacy.unique_emails(f.legacy_orders)
    near = F.abs(F.col("n_estimated") - F.col("n_unique_emails")) <= 4 * 1.04 / 64 * F.col("n_unique_emails")
    return exact.select("n_unique_emails", F.lit(read_distinct(spark, out, "n_estimated").first()[0]).alias("n_estimated")) \
        .select("n_unique_emails", near.alias("estimate_is_near"))


@register("stream_offset_policies", oracle="""
SELECT 'earliest' AS consumer, COUNT(*) AS n_messages, SUM(cost)::BIGINT AS cost FROM f_legacy_orders
UNION ALL SELECT 'latest', COUNT(*), SUM(cost)::BIGINT FROM f_legacy_orders WHERE id::BIGINT % 3 > 0
UNION ALL SELECT 'since', COUNT(*), SUM(cost)::BIGINT FROM f_legacy_orders WHERE id::BIGINT % 3 = 2
""")
def q_stream_offset_policies(spark, sf):
    """A10: a feed that arrives in three parts, read by three consumers with committed progress; each run is a new query.

    ``earliest`` and ``latest`` start on the first part, ``since`` at the time that the second part was complete.
    """
    f, path, root = fx(spark, sf), scratch_path(spark, "confirmed-feed"), scratch_path(spark, "consumers")
    sent = feeds.confirmed_messages(f).withColumn("id", F.get_json_object("value", "$.id").cast("bigint"))
    open_feed = lambda: messages.read_feed(spark, fmt="text", path=path)
    starts, since = {"earliest": "earliest", "latest": "latest"}, None
    for part in range(3):
        (sent.where(F.col("id") % 3 == part).select("value").repartition(_per_trigger(spark)).write.mode("append").text(path))
        if part == 1:
            seen = spark.read.text(path).select(F.max("_metadata.file_modification_time").alias("t"))
            # the next part's files are younger, or this would tell nothing
            since = seen.select(F.unix_millis("t")).first()[0]
            if since is not None:
                starts["since"] = dt.datetime.fromtimestamp((since + 1) / 1000, dt.UTC)
        for name, start in starts.items():
            if name != "since" or part == 2:
                Consumer(name, root).consume(open_feed, start, lambda df, epoch, n=name: append_batch(df, epoch, f"{root}/out-{n}"),
                                             transform=messages.parse_confirmed)
    counts = [spark.read.schema("cost int").parquet(f"{root}/out-{n}").agg(F.count("*").alias("n_messages"), F.sum("cost").alias("cost"))
              .select(F.lit(n).alias("consumer"), "n_messages", "cost") for n in ("earliest", "latest", "since")]
    return counts[0].union(counts[1]).union(counts[2])


@register("stream_latest_positions", oracle=ORACLE_RAW["latest_positions"])
def q_stream_latest_positions(spark, sf):
    """J3 streaming: the newest position per known line."""
    pos = positions_from(_event_stream(spark, fx(spark, sf)))
    out = run_available_now(positions.latest_positions(pos), "stream-latest", mode="update",
                            keys=["busline"])
    return _ntz(out, "position_ts")


@register("stream_offers", oracle="""
SELECT order_id, (SELECT COUNT(DISTINCT rider_id) FROM f_roster) AS n_offers FROM f_requests
""")
def q_stream_offers(spark, sf):
    """C1 streaming: each incoming order is offered to the current rider roster."""
    f = fx(spark, sf)
    path = _write_feed(spark, f.requests.select(F.to_json(F.struct("order_id")).alias("value")), "offer-feed")
    s = messages.parse_order_messages(messages.read_feed(spark, fmt="text", path=path, max_per_trigger=_per_trigger(spark)))
    roster = f.roster

    def write(df, epoch_id, out):
        append_batch(lifecycle.offers(df.select("order_id"), roster), epoch_id, out)

    out = run_available_now(s.select("order_id"), "stream-offers", foreach_batch=write)
    return out.select("order_id", "n_offers")


@register("stream_match", oracle=ORACLE_RAW["match_responses"])
def q_stream_match(spark, sf):
    """C10 streaming: responses joined to the static order table and rider roster."""
    f = fx(spark, sf)
    resp = f.responses_of(_event_stream(spark, f))
    out = run_available_now(lifecycle.match_responses(resp, f.orders, f.roster), "stream-match")
    return _ntz(out, "event_timestamp")


def _shuffled_responses(spark, f) -> tuple[DataFrame, int]:
    """The responses as a feed in no order, closed by a row without an order; and the seconds that they span."""
    path = scratch_path(spark, "response-feed")
    f.responses.repartition(_files(spark)).write.parquet(path)
    span = spark.read.parquet(path).select(F.col("event_timestamp").cast("timestamp").alias("t")).agg(
        F.max("t").alias("last"), (F.unix_seconds(F.max("t")) - F.unix_seconds(F.min("t"))).alias("s")).first()
    if span.last is not None:
        end = spark.createDataFrame([(None, None, None, None, span.last + dt.timedelta(seconds=4 * span.s + 7200))],
                                    schemas.RIDER_RESPONSE)
        end.coalesce(1).write.mode("append").parquet(path)  # the newest file is read last
    feed = table_stream(spark, path, schemas.RIDER_RESPONSE, ts_cols=("event_timestamp",), max_files=_per_trigger(spark))
    return feed, int(span.s or 0)


@register("gate_stream", oracle=ORACLE_RAW["gate_batch"], headline=True)
def q_gate_stream(spark, sf):
    """C6 streaming: the event-time gate over a shuffled feed, whose delay is all the time that it spans."""
    feed, span = _shuffled_responses(spark, fx(spark, sf))
    out = run_available_now(gate_event_time(feed, N, delay=f"{span + 1} seconds", horizon_seconds=span + 1), "stream-gate")
    return _ntz(out, "event_timestamp")


@register("gate_stream_table", oracle=ORACLE_RAW["gate_batch"])
def q_gate_stream_table(spark, sf):
    """C6 streaming with the admitted-response log as the gate state (no per-order Python)."""
    f = fx(spark, sf)
    out = _replay_in_time_order(spark, f, "gate-log", lambda s, out, checkpoint: run_available_now(
        f.responses_of(s), "gate-table", out=out, checkpoint=checkpoint, foreach_batch=gate_into_log(out, N)))
    return _ntz(out.drop("epoch_id"), "event_timestamp")


def _log_in_ranges(spark, f) -> str:
    """The status log as a feed of MICRO_BATCHES ranges of time, written one after the other and read in that order."""
    path, log = scratch_path(spark, "log-ranges"), f.orders_status
    micros = F.unix_micros(F.col("event_timestamp").cast("timestamp"))
    cuts = log.agg(F.percentile_approx(micros, [k / MICRO_BATCHES for k in range(1, MICRO_BATCHES)]).alias("c")).first().c or []
    part = sum((F.when(micros <= c, 0).otherwise(1) for c in cuts), F.lit(0))
    for k in range(MICRO_BATCHES):
        log.where(part == k).repartition(_per_trigger(spark)).write.mode("append").parquet(path)
    return path


@register("stream_kpi_row", oracle=ORACLE_RAW["daily_kpis"], headline=True)
def q_stream_kpi_row(spark, sf):
    """D6 streaming: the daily KPI row kept up to date over the status log, in no order of time."""
    f = fx(spark, sf)
    out = scratch_path(spark, "kpi-row")
    run_available_now(_log_stream(spark, f), "kpi-row", out=out,
                      foreach_batch=kpi_row_writer(out, f.orders, AS_OF, N))
    return read_kpi_row(spark, out)


@register("stream_slots_late", oracle="""
SELECT time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS window_start, COUNT(*) AS num_orders
FROM f_orders_status WHERE status = 'pending' GROUP BY 1
""")
def q_stream_slots_late(spark, sf):
    """D10 streaming with a watermark of a day over a log in no order: on-time and late counts add up to the batch count."""
    out = scratch_path(spark, "slots-late")
    pending = _log_stream(spark, fx(spark, sf)).filter(F.col("status") == "pending")
    run_available_now(pending, "slots-late", out=out, foreach_batch=slot_writer(out, delay_seconds=86400))
    counts = read_slots(spark, out).select("window_start", (F.col("num_orders") + F.col("late_orders")).alias("num_orders"))
    return _ntz(counts, "window_start")


@register("stream_match_window", oracle="""
SELECT r.order_id, r.rider_id, r.status, p.event_timestamp AS offered_at, r.event_timestamp AS answered_at
FROM f_orders_status p JOIN f_orders_status r ON p.order_id = r.order_id
WHERE p.status = 'pending' AND r.status IN ('accepted', 'denied') AND r.rider_id IN (SELECT rider_id FROM f_roster)
  AND r.event_timestamp >= p.event_timestamp AND r.event_timestamp <= p.event_timestamp + INTERVAL 8 MINUTE
""")
def q_stream_match_window(spark, sf):
    """C10 streaming: the feed of placed orders joined to the feed of answers within 8 minutes, both live."""
    f = fx(spark, sf)
    path = _log_in_ranges(spark, f)
    feed = lambda: table_stream(spark, path, schemas.ORDERS_STATUS, ts_cols=("event_timestamp",),
                                max_files=_per_trigger(spark))
    offers = feed().where("status = 'pending'").select("order_id", F.col("event_timestamp").alias("offered_at"))
    answers = (feed().where("status IN ('accepted', 'denied')")
               .select("order_id", "rider_id", "status", F.col("event_timestamp").alias("answered_at")))
    out = run_available_now(match_live(offers, answers, f.roster, within="8 MINUTES", delay="1 day"), "stream-match-window")
    return _ntz(out, "offered_at", "answered_at")
