"""C6 streaming: the decision gate as a stateful operator keyed by order.

Three forms:

* ``gate_event_time``: exact for a feed in any order within a watermark's
  delay. An order's responses wait in the state until the watermark has passed
  them (an event-time timer wakes the state), and are then admitted in
  ``(event_timestamp, response_id)`` order. What is held is cut off where the
  responses seen so far would close the order: later arrivals can only bring
  the cut-off forward. A closed or quiet order is evicted ``horizon`` after
  its last response.
* ``gate_stream``: for feeds whose micro-batches come in event-time order;
  decides at once, without a watermark, and keeps closed orders.
* ``gate_into_log``: a ``foreachBatch`` writer for feeds in event-time order
  that keeps the closing state of the orders in a bucketed table. No order is
  grouped in Python.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from orderflow.operators.lifecycle import admit_responses
from orderflow.schemas import N_RIDERS
from orderflow.streaming.sinks import append_batch
from orderflow.streaming.state_table import StateTable

OUT_SCHEMA = ("response_id long, order_id long, rider_id int, status string, event_timestamp timestamp")
STATE_SCHEMA = "closed boolean, deniers array<int>"
_COLS = ["response_id", "order_id", "rider_id", "status", "event_timestamp"]

#: A response as (micros, response_id, rider_id, status).
Response = tuple[int, int, int | None, str]


def admitted_prefix(responses: list[Response], closed: bool, deniers: Iterable, n_riders: int) -> tuple[int, bool, set]:
    """How many of an order's sorted responses are admitted, and the order's state after them."""
    deniers = set(deniers)
    n = 0
    while n < len(responses) and not closed:
        _, _, rider, status = responses[n]
        if status == "denied":
            deniers.add(rider)
        closed = status == "accepted" or len(deniers) >= n_riders
        n += 1
    return n, closed, deniers


def _responses(pdf: pd.DataFrame) -> list[Response]:
    micros = pdf["event_timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
    riders = pdf["rider_id"].tolist()
    if pdf["rider_id"].dtype.kind == "f":  # some are null
        riders = [None if r != r else int(r) for r in riders]
    return list(zip(micros, pdf["response_id"].tolist(), riders, pdf["status"].tolist()))


def _frame(order_id: int, responses: list[Response]) -> pd.DataFrame:
    micros, ids, riders, statuses = zip(*responses)
    return pd.DataFrame({"response_id": ids, "order_id": order_id, "rider_id": pd.array(riders, "Int32"), "status": statuses,
                         "event_timestamp": np.array(micros, "datetime64[us]")})


def gate_stream(responses: DataFrame, n_riders: int = N_RIDERS) -> DataFrame:
    """Admitted responses of a response stream in event-time order (``event_timestamp`` as ``timestamp``).

    A hot order's responses are read in portions, and only those still admitted are held.
    """

    def step(key, pdfs, state):
        closed, deniers = state.get if state.exists else (False, [])
        before, admitted = (bool(closed), set(deniers or [])), []
        after = before
        for pdf in pdfs:
            # further responses can only bring the cut-off forward, so what isn't admitted now never is
            rows = sorted(admitted + _responses(pdf), key=lambda r: r[:2])
            n, *after = admitted_prefix(rows, *before, n_riders)
            admitted = rows[:n]
        state.update((after[0], list(after[1])))
        if admitted:
            yield _frame(key[0], admitted)

    return (responses.select(*_COLS).groupBy("order_id")
            .applyInPandasWithState(step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))


HELD_SCHEMA = ", ".join(f"{c} array<long>" for c in (
    "h_order", "h_time", "h_id", "h_rider", "h_accepted", "o_order", "o_closed", "o_last", "d_order", "d_rider"))
#: Stands for a null rider, who counts as a rider of his own.
NO_RIDER = -2 ** 31

def prior_decisions(log: DataFrame, n_riders: int = N_RIDERS) -> DataFrame:
    """(order_id, prior_closed, prior_deniers) of a log: at most ``n_riders`` deniers of an order."""
    known = log.where(F.col("rider_id").isNotNull())
    by_rider = Window.partitionBy("order_id").orderBy("rider_id")
    deniers = (known.where("status = 'denied'").select("order_id", "rider_id").distinct()
               .withColumn("k", F.row_number().over(by_rider)).where(F.col("k") <= n_riders)
               .groupBy("order_id").agg(F.collect_list("rider_id").alias("prior_deniers")))
    accepted = known.where("status = 'accepted'").groupBy("order_id").agg(F.lit(True).alias("accepted"))
    return (deniers.join(accepted, "order_id", "full")
            .select("order_id", (F.coalesce("accepted", F.lit(False)) | (F.coalesce(F.size("prior_deniers"), F.lit(0)) >= n_riders))
                    .alias("prior_closed"), "prior_deniers"))


class OpenOrders:
    """The gate's state of some orders: responses held back, orders seen, and their admitted deniers."""

    def __init__(self, held: pd.DataFrame, orders: pd.DataFrame, deniers: pd.DataFrame) -> None:
        self.held, self.orders, self.deniers = held, orders, deniers

    @staticmethod
    def of(columns: tuple) -> OpenOrders:
        c = [np.array(x if x is not None else [], np.int64) for x in columns]
        return OpenOrders(pd.DataFrame(dict(zip(("order", "time", "id", "rider", "accepted"), c[:5]))),
                          pd.DataFrame({"closed": c[6], "last": c[7]}, index=pd.Index(c[5], name="order")),
                          pd.DataFrame({"order": c[8], "rider": c[9]}))

    def columns(self) -> tuple:
        frames = [self.held, self.orders.reset_index(), self.deniers]
        return tuple(f[c].tolist() for f, names in zip(frames, (("order", "time", "id", "rider", "accepted"),
                                                                ("order", "closed", "last"), ("order", "rider"))) for c in names)

    def _admitted(self, rows: pd.DataFrame, n_riders: int) -> tuple[np.ndarray, np.ndarray]:
        """Of rows sorted by order and time: whether each is admitted, and whether it brings a new denier."""
        denies = rows["accepted"].to_numpy() == 0
        pairs = pd.MultiIndex.from_frame(rows[["order", "rider"]])
        new = denies & ~pairs.isin(pd.MultiIndex.from_frame(self.deniers))
        new &= ~pd.Series(np.where(denies, 0, 1)).to_frame("a").assign(o=rows["order"].to_numpy(), r=rows["rider"].to_numpy()) \
            .duplicated().to_numpy()
        before = self.deniers.groupby("order").size().reindex(rows["order"], fill_value=0).to_numpy()
        order = rows["order"].to_numpy()
        earlier = lambda flags: pd.Series(flags.astype(np.int64)).groupby(order).cumsum().to_numpy() - flags
        open_ = self.orders["closed"].reindex(rows["order"], fill_value=0).to_numpy() == 0
        return open_ & (earlier(~denies) == 0) & (before + earlier(new) < n_riders), new

    def take(self, rows: pd.DataFrame, mark: int, n_riders: int, horizon: int) -> pd.DataFrame:
        """Add responses and return, and forget, those admitted that the watermark (micros) has passed."""
        last = pd.concat([self.orders["last"], rows.groupby("order")["time"].max()]).groupby(level=0).max()
        self.orders = pd.DataFrame({"closed": self.orders["closed"].reindex(last.index, fill_value=0), "last": last})
        self.orders.index.name = "order"
        rows = pd.concat([self.held, rows], ignore_index=True).sort_values(["order", "time", "id"], ignore_index=True)
        # later responses can only bring an order's end forward: what isn't admitted now never is
        admitted, new = self._admitted(rows, n_riders)
        due = admitted & (rows["time"].to_numpy() <= mark)
        out, self.held = rows[due], rows[admitted & ~due]
        self.deniers = pd.concat([self.deniers, rows.loc[due & new, ["order", "rider"]]], ignore_index=True)
        counts = self.deniers.groupby("order").size().reindex(self.orders.index, fill_value=0)
        closed = (self.orders["closed"] > 0) | self.orders.index.isin(out.loc[out["accepted"] > 0, "order"]) | (counts >= n_riders)
        self.orders["closed"] = closed.astype(np.int64)
        stays = (self.orders["last"] + horizon > mark) | self.orders.index.isin(self.held["order"])
        self.orders = self.orders[stays]
        self.deniers = self.deniers[self.deniers["order"].isin(self.orders.index)]
        return out

    def wakes(self, horizon: int) -> int | None:
        """The watermark (micros) at which something becomes due; None if nothing is left."""
        idle = self.orders.loc[~self.orders.index.isin(self.held["order"]), "last"] + horizon
        times = [int(x.min()) for x in (self.held["time"], idle) if len(x)]
        return min(times, default=None)


def gate_event_time(responses: DataFrame, n_riders: int = N_RIDERS, *, delay: str, horizon_seconds: int = 7 * 86400,
                    log: DataFrame | None = None, groups: int = 64) -> DataFrame:
    """Admitted responses of a stream that is out of order by at most ``delay``; equal to the batch gate.

    Orders are dealt into ``groups`` by hash, so that Python is called for a group and not for every order; choose as
    many as keep a group's open orders within a task's memory. ``log``: decisions that count before any response
    (``prior_decisions``, a stream-static join). Spark drops responses that come after the watermark has passed their
    time, and so does the gate; responses without a time are dropped. An order is forgotten ``horizon_seconds`` after
    its last response: one that comes later still would meet an open order. A feed that ends is flushed by rows
    without an order and a time far ahead.
    """
    columns, horizon, seeded = [*_COLS, "gate_group"], horizon_seconds * 1_000_000, log is not None
    if seeded:
        responses = responses.join(prior_decisions(log, n_riders), "order_id", "left")
        columns += ["prior_closed", "prior_deniers"]

    def step(key, pdfs, state):
        held = OpenOrders.of(state.get if state.exists else (None,) * 10)
        mark = state.getCurrentWatermarkMs() * 1000
        parts = []
        for pdf in () if state.hasTimedOut else pdfs:
            pdf = pdf[pdf["order_id"].notna()]
            if seeded:
                first = pdf.drop_duplicates("order_id")
                first = first[~first["order_id"].isin(held.orders.index) & first["prior_closed"].notna()]
                known = pd.Index(first["order_id"].astype(np.int64), name="order")
                held.orders = pd.concat([held.orders, pd.DataFrame({"closed": first["prior_closed"].astype(np.int64).to_numpy(),
                                                                    "last": 0}, index=known)])
                lists = [x if x is not None else [] for x in first["prior_deniers"]]
                held.deniers = pd.concat([held.deniers, pd.DataFrame({
                    "order": np.repeat(known.to_numpy(), [len(x) for x in lists]),
                    "rider": np.array([r for x in lists for r in x], np.int64)})], ignore_index=True)
            parts.append(pd.DataFrame({
                "order": pdf["order_id"].astype(np.int64),
                "time": pdf["event_timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64),
                "id": pdf["response_id"].astype(np.int64), "rider": pdf["rider_id"].fillna(NO_RIDER).astype(np.int64),
                "accepted": (pdf["status"] == "accepted").astype(np.int64)}))
        new = pd.concat(parts, ignore_index=True) if parts else held.held.iloc[:0]
        out = held.take(new, mark, n_riders, horizon)
        wake = held.wakes(horizon)
        if wake is not None:
            state.update(held.columns())
            state.setTimeoutTimestamp(max(-(-wake // 1000) - 1, mark // 1000))  # runs once the watermark is beyond
        elif state.exists:
            state.remove()
        if len(out):
            yield pd.DataFrame({"response_id": out["id"], "order_id": out["order"],
                                "rider_id": out["rider"].astype("Int32").where(out["rider"] != NO_RIDER),
                                "status": np.where(out["accepted"] > 0, "accepted", "denied"),
                                "event_timestamp": out["time"].to_numpy().astype("datetime64[us]")})

    group = F.pmod(F.xxhash64("order_id"), F.lit(groups)).cast("int").alias("gate_group")
    return (responses.where(F.col("event_timestamp").isNotNull()).withWatermark("event_timestamp", delay)
            .select("*", group).select(*columns).groupBy("gate_group")
            .applyInPandasWithState(step, OUT_SCHEMA, HELD_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


LOG_SCHEMA = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("rider_id", T.IntegerType()),
                           T.StructField("status", T.StringType())])


def gate_into_log(log_path: str, n_riders: int = N_RIDERS, seed_log: DataFrame | None = None, *,
                  state_path: str | None = None, buckets: int = 32):
    """C6 streaming, table-state form: ``foreachBatch`` writer for ``run_available_now``.

    Each micro-batch runs the batch cut-off gate (``admit_responses``) against
    the closing state of its orders and appends its admitted rows to
    ``<log_path>/epoch_id=<n>``. The closing state holds an order's distinct
    admitted (rider, status) pairs, at most ``n_riders`` denials and one
    acceptance, in a ``StateTable`` beside the log: an epoch reads the buckets
    that its orders fall into and never the whole log. A replayed epoch sees
    the state it saw the first time, and overwrites both its folders.

    ``seed_log`` counts before everything (only the batch's orders are read of it).
    """
    state = StateTable(state_path or log_path + "-state", "order_id", LOG_SCHEMA, buckets)

    def write(batch: DataFrame, epoch_id: int, out: str) -> None:
        spark = batch.sparkSession
        touched = state.touched(batch)
        prior = state.read(spark, epoch_id, touched)
        seen = prior if seed_log is None else prior.unionByName(seed_log.select(*LOG_SCHEMA.names))
        append_batch(admit_responses(batch, n_riders, log=seen), epoch_id, log_path)
        admitted = spark.read.parquet(f"{log_path}/epoch_id={epoch_id}").select(*LOG_SCHEMA.names)
        if touched:
            state.write(prior.unionByName(admitted).distinct(), epoch_id, touched)
            state.compact(spark, epoch_id)

    return write
