"""Views that turn the generic test tables into the order-flow tables.

The definitions follow FIXTURES.md; the DuckDB oracle uses the SQL text in
``orderflow.plans.oracle``.  Here they are DataFrame expressions so every
downstream operator sees ordinary lazy scans: a filter on ``event_timestamp``
written by an operator is pushed through these projections into the parquet
reader.

Fixed values of the fixture mapping: the reporting day is 1998-06-15, every
order key divisible by 10 is placed on it, timestamps are spread with the
multiplier 7919 modulo 86400 seconds, and part types map to categories as
ECONOMY->Pizza, STANDARD->Salad, PROMO->Burger, SMALL->Drink, LARGE->Wrap,
anything else -> NULL.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.sources.tables import read_table

AS_OF = dt.date(1998, 6, 15)
FIXTURE_DAY = "1998-06-15 00:00:00"


def _plus_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, ts)


def _plus_minutes(ts: Column, mins: Column) -> Column:
    return F.timestamp_add("MINUTE", mins, ts)


class Fixtures:
    """Lazily built fixture views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name)

    # -- dimensions -----------------------------------------------------
    @cached_property
    def menu_items(self) -> DataFrame:
        p = self.table("part")
        category = (F.when(F.col("p_type") == "ECONOMY", "Pizza")
                    .when(F.col("p_type") == "STANDARD", "Salad")
                    .when(F.col("p_type") == "PROMO", "Burger")
                    .when(F.col("p_type") == "SMALL", "Drink")
                    .when(F.col("p_type") == "LARGE", "Wrap"))
        return p.select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_type") == "SMALL", F.lit(None).cast("string"))
             .otherwise(F.col("p_brand")).alias("description"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            category.alias("category"),
            F.lit(dt.date(1995, 1, 1)).alias("date_added"),
        )

    @cached_property
    def n_riders(self) -> int:
        return max(1, self.table("supplier").count())

    @cached_property
    def n_answered(self) -> int:
        """Orders that responses go to: an eighth of all, so that an order gets several whatever the scale."""
        return max(1, self.table("orders").count() // 8)

    @cached_property
    def roster(self) -> DataFrame:
        """The rider table: every supplier."""
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").cast("int").alias("rider_id"), F.col("s_name").alias("name"))

    # -- facts ----------------------------------------------------------
    @cached_property
    def pending(self) -> DataFrame:
        o = self.table("orders")
        base = (F.when(F.col("o_orderkey") % 10 == 0, F.lit(FIXTURE_DAY).cast("timestamp_ntz"))
                 .otherwise(F.col("o_orderdate")))
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("outcome"),
            _plus_seconds(base, (F.col("o_orderkey") * 7919) % 86400).alias("ts"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        o = self.table("orders")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        n = self.table("nation").select("n_nationkey", "n_name")
        return (o.join(c, o.o_custkey == c.c_custkey)
                 .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                 .select(F.col("o_orderkey").alias("order_id"),
                         F.col("o_custkey").alias("user_id"),
                         F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
                         F.lit("pending").alias("status"),
                         F.col("n_name").alias("delivery_city")))

    @cached_property
    def order_details(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(F.col("l_orderkey").alias("order_id"),
                         F.col("l_partkey").alias("item_id"),
                         F.col("l_quantity").cast("int").alias("quantity"),
                         F.col("l_extendedprice").cast("decimal(10,2)").alias("subtotal"))

    @cached_property
    def orders_status(self) -> DataFrame:
        """Append-only status log: one pending row per order plus rider events."""
        p = self.pending
        rider_of = (F.col("order_id") % self.n_riders).cast("int")
        pend = p.select("order_id", F.lit("pending").alias("status"),
                        F.lit(None).cast("int").alias("rider_id"),
                        F.col("ts").alias("event_timestamp"))
        acc = (p.filter(F.col("outcome") == "F")
                .select("order_id", F.lit("accepted").alias("status"), rider_of.alias("rider_id"),
                        _plus_minutes(F.col("ts"), 1 + F.col("order_id") % 11).alias("event_timestamp")))
        comp = (p.filter((F.col("outcome") == "F") & (F.col("order_id") % 7 != 0))
                 .select("order_id", F.lit("completed").alias("status"), rider_of.alias("rider_id"),
                         _plus_minutes(F.col("ts"), 2 * (1 + F.col("order_id") % 11) + F.col("order_id") % 17)
                         .alias("event_timestamp")))
        # Denials by the riders after the order's own: 3 for outcome P, order_id % 3 for outcome O.
        n_deny = F.when(F.col("outcome") == "P", 3).otherwise(F.col("order_id") % 3)
        den = (p.filter(F.col("outcome").isin("P", "O"))
                .withColumn("nth", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
                .filter(F.col("nth") <= n_deny)
                .select("order_id", F.lit("denied").alias("status"),
                        ((F.col("order_id") + F.col("nth")) % self.n_riders).cast("int").alias("rider_id"),
                        _plus_minutes(F.col("ts"), F.col("nth") + F.col("order_id") % 9)
                        .alias("event_timestamp")))
        return pend.unionByName(acc).unionByName(comp).unionByName(den)

    @cached_property
    def users(self) -> DataFrame:
        c = self.table("customer").select("c_custkey", "c_name", "c_nationkey")
        n = self.table("nation").select("n_nationkey", "n_name")
        first = self.pending.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                 .join(first, F.col("c_custkey") == F.col("user_id"), "left")
                 .select(F.col("c_custkey").alias("user_id"),
                         F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
                         F.concat(F.lit("+39"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
                          .alias("phone_number"),
                         F.col("n_name").alias("city"),
                         F.to_date(F.col("first_ts")).alias("registration_date")))

    @cached_property
    def users_existing(self) -> DataFrame:
        return self.users.filter(F.col("user_id") % 2 == 0)

    @cached_property
    def requests(self) -> DataFrame:
        u = self.users.select("user_id", "email", "phone_number", "city")
        return (self.pending.join(u, "user_id")
                .select("order_id",
                        F.when(F.col("order_id") % 77 == 0, F.lit("")).otherwise(F.col("email")).alias("email"),
                        "phone_number", "city",
                        F.col("ts").alias("order_created_timestamp")))

    @cached_property
    def request_lines(self) -> DataFrame:
        li = self.table("lineitem")
        item = (F.when((F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1),
                       F.col("l_partkey") + 1000000000).otherwise(F.col("l_partkey")))
        y = (li.select(F.col("l_orderkey").alias("order_id"), item.alias("item_id"),
                       F.col("l_quantity").cast("int").alias("q"))
               .groupBy("order_id", "item_id").agg(F.sum("q").cast("int").alias("quantity")))
        return y.select("order_id", "item_id",
                        F.when((F.col("order_id") % 91 == 0) & (F.col("item_id") % 2 == 0),
                               F.lit(None).cast("int")).otherwise(F.col("quantity")).alias("quantity"))

    @cached_property
    def order_requests(self) -> DataFrame:
        """Nested order messages: ``order_info`` map of item id (string) -> quantity.

        The map is built per order from that order's own lines (one message is
        one order, so this is the message's own size), with entries sorted by
        item id so the message text is deterministic; orders without lines keep
        ``order_info = NULL``.
        """
        info = (self.request_lines
                .groupBy("order_id")
                .agg(F.map_from_entries(F.array_sort(F.collect_list(
                    F.struct(F.col("item_id").cast("string"), F.col("quantity"))))).alias("order_info")))
        return self.requests.join(info, "order_id", "left")

    @cached_property
    def responses(self) -> DataFrame:
        return self.responses_of(self.table("events"))

    def responses_of(self, events: DataFrame) -> DataFrame:
        """The responses of an event frame, also a streaming one."""
        return responses_from(events, self.n_answered, self.n_riders)

    @cached_property
    def decisions(self) -> DataFrame:
        return decisions_from(self.table("events"), self.n_answered, self.n_riders)

    @cached_property
    def positions(self) -> DataFrame:
        return positions_from(self.table("events"))

    @cached_property
    def legacy_orders(self) -> DataFrame:
        o = self.table("orders")
        c = self.table("customer").select("c_custkey", "c_name")
        return (o.join(c, o.o_custkey == c.c_custkey)
                 .select(F.col("o_orderkey").cast("string").alias("id"),
                         F.col("c_name").alias("username"),
                         F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
                         F.col("o_orderpriority").alias("food"),
                         F.col("o_orderstatus").alias("size"),
                         F.floor(F.col("o_totalprice")).cast("int").alias("cost"),
                         _plus_seconds(F.col("o_orderdate"), (F.col("o_orderkey") * 7919) % 86400).alias("time"),
                         F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("order_completed")))


# -- mappings of the event table (shared by batch views and streams) ----------

def responses_from(e: DataFrame, n_orders: int, n_riders: int) -> DataFrame:
    """Rider responses: click -> accepted, any other event -> denied; orders 0 to n_orders - 1 in turn."""
    return e.select(F.col("event_id").alias("response_id"),
                    (F.col("event_id") % n_orders).alias("order_id"),
                    (F.col("user_id") % n_riders).cast("int").alias("rider_id"),
                    F.when(F.col("event_type") == "click", "accepted").otherwise("denied").alias("status"),
                    F.col("ts").alias("event_timestamp"))


def decisions_from(e: DataFrame, n_orders: int, n_riders: int) -> DataFrame:
    """Raw typed decisions (mixed case, some invalid)."""
    decision = (F.when(F.col("event_type") == "click", "Yes")
                .when(F.col("event_type") == "error", "NO")
                .when(F.col("event_type") == "view", "maybe")
                .when(F.col("event_type") == "signup", "yes")
                .otherwise("no"))
    return e.select(F.col("event_id").alias("response_id"),
                    (F.col("event_id") % n_orders).alias("order_id"),
                    (F.col("user_id") % n_riders).cast("int").alias("rider_id"),
                    decision.alias("decision"),
                    F.col("ts").alias("event_timestamp"))


def positions_from(e: DataFrame) -> DataFrame:
    """Vehicle positions: five lines ``00000``..``00004``."""
    return e.select("event_id",
                    F.lpad((F.col("user_id") % 5).cast("string"), 5, "0").alias("busline"),
                    F.col("ts").alias("position_ts"),
                    (51.5 + F.col("value") / 10000).alias("latitude"),
                    (-0.1 - F.col("value") / 10000).alias("longitude"))
