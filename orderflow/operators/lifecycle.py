"""Dispatch, decision gate and order state.

The status log is the source of truth; every state below is derived from it
with grouped aggregates keyed by ``order_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.operators.daily import order_status_stats
from orderflow.schemas import N_RIDERS


# -- roster and enrichment ------------------------------------------------------

def active_riders(riders: DataFrame) -> DataFrame:
    """Rider ids."""
    return riders.select("rider_id")


def with_rider_name(df: DataFrame, riders: DataFrame) -> DataFrame:
    """Add ``rider_name``.  The rider table is a dimension; the join strategy
    (broadcast when its measured size is under the threshold) is left to the
    planner/AQE rather than forced."""
    return df.join(riders.select("rider_id", F.col("name").alias("rider_name")), "rider_id", "left")


def offers(orders: DataFrame, riders: DataFrame) -> DataFrame:
    """Every order is offered to every rider.

    Kept in compact form: one row per order with the number of riders it was
    offered to (a scalar subquery over the rider table), instead of
    materialising the order x rider product.  ``match_responses`` checks a
    response against the roster with equi-joins.
    """
    n = riders.agg(F.countDistinct("rider_id").alias("n")).scalar()
    return orders.select("order_id", n.alias("n_offers"))


def normalise_decisions(df: DataFrame, column: str = "decision") -> DataFrame:
    """C4: lower-cased ``yes`` -> accepted, ``no`` -> denied, anything else invalid."""
    d = F.lower(F.col(column))
    return df.withColumn("status", F.when(d == "yes", "accepted").when(d == "no", "denied")
                         .otherwise("invalid"))


def match_responses(responses: DataFrame, orders: DataFrame, riders: DataFrame) -> DataFrame:
    """Keep responses whose (order, rider) pair was offered.

    An offer exists for every known order and every known rider, so the
    pair test is two equi-joins: orders on ``order_id`` (carrying the order
    total) and a semi join on the rider roster.
    """
    o = orders.select("order_id", "total_amount")
    return (responses.join(o, "order_id")
            .join(riders.select("rider_id"), "rider_id", "left_semi"))


def latest_order_id(orders: DataFrame) -> DataFrame:
    """C11: newest order id (a max, not a sort)."""
    return orders.agg(F.max("order_id").alias("latest_order_id"))


# -- state --------------------------------------------------------------------------

def gate_state(events: DataFrame, n_riders: int = N_RIDERS) -> DataFrame:
    """Per order, distinct acceptors/deniers and the gate verdict.

    ``not_pending`` iff exactly one rider accepted or ``n_riders`` distinct
    riders denied (the original test, literally).
    """
    s = order_status_stats(events)
    return s.select("order_id",
                    F.col("accepted_riders").alias("accepted_count"),
                    F.col("denied_riders").alias("denied_count"),
                    F.when((F.col("accepted_riders") == 1) | (F.col("denied_riders") == n_riders),
                           "not_pending").otherwise("pending").alias("state"))


def order_outcomes(events: DataFrame, n_riders: int = N_RIDERS) -> DataFrame:
    """Pending / accepted / failed / completed, precedence completed > accepted > failed."""
    s = order_status_stats(events)
    outcome = (F.when(F.col("n_completed") > 0, "completed")
               .when(F.col("accepted_riders") > 0, "accepted")
               .when(F.col("denied_riders") >= n_riders, "failed")
               .otherwise("pending"))
    return s.select("order_id", outcome.alias("outcome"))


def admit_responses(responses: DataFrame, n_riders: int = N_RIDERS,
                    log: DataFrame | None = None) -> DataFrame:
    """The decision gate in batch: which rider responses get into the log.

    Sequential semantics, per order in ``(event_timestamp, response_id)``
    order: a response is admitted while the order is open; the order closes
    at the first admitted acceptance or when ``n_riders`` distinct riders
    have denied.  Rows already in ``log`` count first (riders who denied
    there are not new deniers; any acceptance there closes the order).
    Serialising per order fixes the original's race where two riders could
    both accept (T6).

    Because everything before the closing response is admitted and
    everything after it is rejected, the gate is a cut-off per order:

        close = min(first acceptance, first denial of the k-th new denier)

    with ``k = n_riders - deniers already in the log``.  The k-th new
    denier is found on the (order, rider) aggregate, whose size per order
    is bounded by the rider count, not by the number of responses.  A hot
    order therefore never has to be sorted or held in one task; the only
    per-response work is one join to the per-order cut-off, which AQE can
    split when skewed.
    """
    key = F.struct("event_timestamp", "response_id")
    r = responses.select("response_id", "order_id", "rider_id", "status", "event_timestamp")

    if log is not None:
        # Only the log of orders that receive responses matters; the semi join's
        # small side (the responses' distinct order ids) is broadcast by AQE.
        touched = r.select("order_id").distinct()
        prior = (log.filter(F.col("rider_id").isNotNull() & F.col("status").isin("accepted", "denied"))
                 .select("order_id", "rider_id", "status")
                 .join(touched, "order_id", "left_semi").distinct())
        prior_orders = prior.groupBy("order_id").agg(
            F.count(F.when(F.col("status") == "accepted", 1)).alias("a0"),
            F.count(F.when(F.col("status") == "denied", 1)).alias("d0"))
        prior_deniers = prior.filter(F.col("status") == "denied").select("order_id", "rider_id")
    else:
        prior_orders = None
        prior_deniers = None

    first_accept = (r.filter(F.col("status") == "accepted")
                    .groupBy("order_id").agg(F.min(key).alias("acc_key")))

    deniers = (r.filter(F.col("status") == "denied")
               .groupBy("order_id", "rider_id").agg(F.min(key).alias("deny_key")))
    if prior_deniers is not None:
        deniers = deniers.join(prior_deniers, ["order_id", "rider_id"], "left_anti")
        deniers = deniers.join(prior_orders.select("order_id", "d0"), "order_id", "left")
        need = F.lit(n_riders) - F.coalesce(F.col("d0"), F.lit(0))
    else:
        need = F.lit(n_riders)
    w = Window.partitionBy("order_id").orderBy("deny_key")
    # The literal bound lets Spark plan a partial WindowGroupLimit: every map
    # task keeps at most n_riders candidates per order before the shuffle, so
    # an order denied by a huge number of riders never reaches one task whole.
    nth_denial = (deniers.withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= n_riders)
                  .filter(F.col("rank") == need)
                  .select("order_id", F.col("deny_key").alias("quorum_key")))

    cut = first_accept.join(nth_denial, "order_id", "full").select(
        "order_id", F.least("acc_key", "quorum_key").alias("close_key"))
    admitted = r.join(cut, "order_id", "left").filter(
        F.col("close_key").isNull() | (key <= F.col("close_key")))
    if prior_orders is not None:
        closed = prior_orders.filter((F.col("a0") >= 1) | (F.col("d0") >= n_riders)).select("order_id")
        admitted = admitted.join(closed, "order_id", "left_anti")
    return admitted.select("response_id", "order_id", "rider_id", "status", "event_timestamp")


# -- rider's view ------------------------------------------------------------------------

def rider_orders(events: DataFrame, orders: DataFrame, rider_id: int) -> DataFrame:
    """The rider's accepted-but-not-completed and completed orders.

    Each row carries the order's creation (pending) time, its acceptance time
    (the row's own time for acceptances, else the order's earliest
    acceptance -- the original's scalar subquery, made total with ``min``,
    T13), its completion time and total.  Accepted rows disappear once the
    order has any completion (anti join).
    """
    mine = events.filter((F.col("rider_id") == rider_id) & F.col("status").isin("accepted", "completed"))
    # Everything else is needed only for this rider's orders: restrict the
    # log to those ids first (a semi join whose small side AQE broadcasts),
    # so the whole log is never shuffled for one rider's view.
    ids = mine.select("order_id").distinct()
    log = events.join(ids, "order_id", "left_semi")
    done = log.filter(F.col("status") == "completed").select("order_id")
    mine = (mine.filter(F.col("status") == "accepted").join(done, "order_id", "left_anti")
            .unionByName(mine.filter(F.col("status") == "completed")))
    created = log.filter(F.col("status") == "pending").select(
        "order_id", F.col("event_timestamp").alias("order_creation_timestamp"))
    accepted_at = (log.filter(F.col("status") == "accepted")
                   .groupBy("order_id").agg(F.min("event_timestamp").alias("acc_ts")))
    totals = orders.select("order_id", "total_amount").join(ids, "order_id", "left_semi")
    return (mine.join(created, "order_id")
            .join(accepted_at, "order_id", "left")
            .join(totals, "order_id", "left")
            .select("order_id", "rider_id", "status", "order_creation_timestamp",
                    F.when(F.col("status") == "accepted", F.col("event_timestamp"))
                     .otherwise(F.col("acc_ts")).alias("order_acceptance_timestamp"),
                    F.when(F.col("status") == "completed", F.col("event_timestamp"))
                     .alias("order_completion_timestamp"),
                    "total_amount")
            .orderBy(F.col("order_acceptance_timestamp").desc_nulls_first()))
