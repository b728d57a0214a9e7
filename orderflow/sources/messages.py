"""Message feeds (A5, A6, A8, A9, A10, A12): JSON values on topics.

The same parsers run on batch and streaming DataFrames: a feed is any frame
with a ``value`` column (Kafka's binary value, or text lines of a file
feed) and optionally ``topic`` / ``key``.  ``read_feed`` opens the feed as
a stream from Kafka or from files; file feeds are what tests use (the Kafka
connector jar is not part of this environment).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow import schemas
from orderflow.streaming.offsets import kafka_start


def read_feed(spark: SparkSession, *, fmt: str = "kafka", path: str | None = None,
              topics: str | None = None, options: dict | None = None,
              starting_offsets: str | dt.datetime = "earliest", max_per_trigger: int | None = None) -> DataFrame:
    """Open a message feed as a stream of ``(topic, key, value)`` rows.

    ``fmt='kafka'``: subscribe to ``topics`` (comma separated, A9), offsets
    policy ``starting_offsets`` (A10: ``earliest``, ``latest`` or a datetime;
    progress is kept by the query's checkpoint, not by a consumer group;
    ``streaming.offsets`` has the policies of file feeds and named progress).  ``fmt='text'``: JSON lines files
    under ``path``; ``topic`` is then the name of the first-level folder
    ``topic=<name>`` when present.
    """
    opts = dict(options or {})
    if fmt == "kafka":
        r = spark.readStream.format("kafka").option("subscribe", topics).options(**kafka_start(starting_offsets))
        if max_per_trigger:
            r = r.option("maxOffsetsPerTrigger", str(max_per_trigger))
        for k, v in opts.items():
            r = r.option(k, v)
        return r.load().select("topic", F.col("key").cast("string").alias("key"),
                               F.col("value").cast("string").alias("value"))
    r = spark.readStream.format("text")
    if max_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_per_trigger))
    for k, v in opts.items():
        r = r.option(k, v)
    df = r.load(path)
    topic = F.col("topic") if "topic" in df.columns else F.lit(None).cast("string")
    return df.select(topic.alias("topic"), F.lit(None).cast("string").alias("key"), "value")


def to_messages(df: DataFrame, key: str | Column | None = None) -> DataFrame:
    """Rows -> ``(key, value)`` JSON messages (the Kafka sink's shape)."""
    k = F.col(key) if isinstance(key, str) else key
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select((k.cast("string") if k is not None else F.lit(None).cast("string")).alias("key"),
                     value.alias("value"))


def write_messages(df: DataFrame, path: str, key: str | None = None, *, fmt: str = "text",
                   topic: str | None = None, options: dict | None = None) -> None:
    """Publish rows as JSON messages: Kafka topic, or JSON-lines files for tests."""
    msgs = to_messages(df, key)
    if fmt == "kafka":
        w = msgs.write.format("kafka").option("topic", topic)
        for k, v in (options or {}).items():
            w = w.option(k, v)
        w.save()
    else:
        msgs.select("value").write.mode("overwrite").text(path)


def parse_json(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """``from_json`` with an explicit schema, flattened (``data.*``)."""
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("data")).select("data.*")


def parse_order_messages(df: DataFrame) -> DataFrame:
    """A5: order messages (``order_info`` is a map of item id -> quantity)."""
    return parse_json(df, schemas.ORDER_MESSAGE)


def parse_confirmed(df: DataFrame) -> DataFrame:
    """Confirmed-order messages -> legacy order rows.

    Producers disagree on the user field (``username`` vs ``user``, T22);
    both are read and coalesced.
    """
    p = parse_json(df, schemas.CONFIRMED_MESSAGE)
    return p.select("id", F.coalesce("username", "user").alias("username"), "email", "food", "size",
                    "cost", "time", "order_completed")


def parse_completed(df: DataFrame) -> DataFrame:
    """Completed-order messages ``{order_id, email_id}``."""
    return parse_json(df, schemas.COMPLETED_MESSAGE)


def route_by_topic(df: DataFrame, confirmed_topic: str = "order_confirmed",
                   completed_topic: str = "order_completed") -> DataFrame:
    """One feed subscribed to two topics, each parsed with its own schema.

    Output: ``topic, order_id, email`` for both kinds of message.
    """
    conf = df.filter(F.col("topic") == confirmed_topic)
    comp = df.filter(F.col("topic") == completed_topic)
    c1 = (conf.select("topic", F.from_json("value", schemas.CONFIRMED_MESSAGE).alias("m"))
          .select("topic", F.col("m.id").alias("order_id"), F.col("m.email").alias("email")))
    c2 = (comp.select("topic", F.from_json("value", schemas.COMPLETED_MESSAGE).alias("m"))
          .select("topic", F.col("m.order_id").cast("string").alias("order_id"),
                  F.col("m.email_id").alias("email")))
    return c1.unionByName(c2)


def parse_positions(df: DataFrame) -> DataFrame:
    """Position messages; the ``timestamp`` text becomes ``position_ts``."""
    p = parse_json(df, schemas.POSITION_MESSAGE)
    return p.select("busline", "key", F.to_timestamp_ntz("timestamp").alias("position_ts"),
                    "latitude", "longitude")


def position_key(busline: Column, event_id: Column) -> Column:
    """Message key ``<busline>_<id>`` (deterministic, replayable)."""
    return F.concat_ws("_", busline, event_id.cast("string"))
