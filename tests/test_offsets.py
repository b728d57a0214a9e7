"""Start policies and committed progress of consumers, over restarts; sketches of distinct values."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from orderflow.session import list_folder, scratch_path
from orderflow.sources.messages import read_feed
from orderflow.streaming.offsets import Consumer, kafka_start
from orderflow.streaming.sketches import read_distinct, sketch_writer


class Feed:
    def __init__(self, spark):
        self.spark, self.path, self.n = spark, scratch_path(spark, "feed"), 0
        os.makedirs(self.path)

    def send(self, *values, at=None):
        self.n += 1
        name = f"{self.path}/{self.n}.txt"
        with open(name, "w") as f:
            f.write("\n".join(values) + "\n")
        if at is not None:
            os.utime(name, (at.timestamp(), at.timestamp()))

    def open(self):
        return read_feed(self.spark, fmt="text", path=self.path)


class Reader:
    """A consumer whose runs are new objects each time, as after a restart."""

    def __init__(self, spark, feed, start, name="c", root=None):
        self.spark, self.feed, self.start, self.name = spark, feed, start, name
        self.root = root or scratch_path(spark, "consumers")
        self.out = scratch_path(spark, "consumed")

    def run(self, fail=False, **more):
        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{self.out}/epoch={epoch}")
            if fail:
                raise RuntimeError("sink lost")
        Consumer(self.name, self.root).consume(self.feed.open, self.start, write, **more)

    def got(self, column="value"):
        if not list_folder(self.spark, self.out):
            return []
        return sorted(r[0] for r in self.spark.read.parquet(self.out).select(column).collect())


def test_earliest_reads_all_and_goes_on(spark):
    feed = Feed(spark)
    feed.send("a", "b")
    c = Reader(spark, feed, "earliest")
    c.run()
    assert c.got() == ["a", "b"]
    c.run()  # nothing new
    feed.send("c")
    c.start = "latest"  # counts only without progress
    c.run()
    assert c.got() == ["a", "b", "c"]


def test_latest_skips_what_is_there_once(spark):
    feed = Feed(spark)
    feed.send("a")
    c = Reader(spark, feed, "latest")
    c.run()
    assert c.got() == []
    feed.send("b")
    feed.send("c", at=dt.datetime.now() - dt.timedelta(days=1))  # a clock behind does not hide it
    c.run()
    assert c.got() == ["b", "c"]


def test_since_goes_by_the_files_times_and_is_kept(spark):
    feed, since = Feed(spark), dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    feed.send("before", at=since - dt.timedelta(seconds=1))
    feed.send("at", at=since)
    c = Reader(spark, feed, since)
    c.run()
    assert c.got() == ["at"]
    feed.send("late and old", at=since - dt.timedelta(days=1))
    feed.send("after", at=since + dt.timedelta(days=1))
    c.start = "earliest"
    c.run()
    assert c.got() == ["after", "at"]
    assert Consumer("c", c.root).position(spark) == {"since": 1704153600000}


def test_consumers_do_not_share_progress_and_reset_starts_anew(spark):
    feed, root = Feed(spark), scratch_path(spark, "consumers")
    feed.send("a")
    one, two = Reader(spark, feed, "earliest", "one", root), Reader(spark, feed, "earliest", "two", root)
    one.run()
    feed.send("b")
    two.run()
    assert one.got() == ["a"] and two.got() == ["a", "b"]
    Consumer("one", root).reset(spark)
    one.run()
    assert one.got() == ["a", "b"]


def test_failed_epoch_is_replayed(spark):
    feed = Feed(spark)
    feed.send("a")
    c = Reader(spark, feed, "earliest")
    with pytest.raises(Exception, match="sink lost"):
        c.run(fail=True)
    feed.send("b")
    c.run()
    assert c.got() == ["a", "b"]  # the epoch's folder was overwritten


def test_latest_with_state(spark):
    feed = Feed(spark)
    feed.send("a", "a")
    c = Reader(spark, feed, "latest")
    count = dict(transform=lambda s: s.groupBy("value").agg(F.count("*").alias("n")), mode="complete")
    c.run(**count)
    feed.send("a", "b")
    c.run(**count)
    assert c.got("n") == [1, 1]


def test_kafka_options_and_wrong_start(spark):
    assert kafka_start("earliest") == {"startingOffsets": "earliest"}
    assert kafka_start(dt.datetime(1970, 1, 1, 0, 0, 1)) == {"startingTimestamp": "1000",
                                                           "startingOffsetsByTimestampStrategy": "latest"}
    with pytest.raises(ValueError, match="start must be"):
        kafka_start("newest")
    with pytest.raises(ValueError, match="start must be"):
        Consumer("c", scratch_path(spark, "consumers")).consume(Feed(spark).open, "newest", lambda b, e: None)


def emails(spark, numbers):
    return spark.createDataFrame([(None if i is None else f"u{i}@example.com",) for i in numbers], "email string")


def test_sketches_merge_to_the_batch_sketch(spark):
    out, whole = scratch_path(spark, "sketches"), scratch_path(spark, "sketches")
    parts = [range(0, 4000), range(2000, 7000), [None, 1, 1], [], range(6000, 9000)]
    write = sketch_writer(out, "email", merge_after=2)
    for epoch, part in enumerate(parts):
        write(emails(spark, part), epoch)
        write(emails(spark, part), epoch)  # a replay
    everyone = emails(spark, [i for p in parts for i in p])
    sketch_writer(whole, "email")(everyone, 0)
    merged, batch = read_distinct(spark, out).first()[0], read_distinct(spark, whole).first()[0]
    assert merged == batch and abs(merged - 9000) <= 4 * 1.04 / 64 * 9000
    assert len(list_folder(spark, out)) <= 4  # merged on the way


def test_sketches_survive_a_crash_between_base_and_clean_up(spark, monkeypatch):
    from orderflow.streaming import sketches
    out = scratch_path(spark, "sketches")
    write = sketch_writer(out, "email", merge_after=2)
    for epoch, part in enumerate([range(10), range(5, 20)]):
        write(emails(spark, part), epoch)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(sketches, "delete_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        write(emails(spark, range(100, 110)), 2)
    assert read_distinct(spark, out).first()[0] == 20
    write(emails(spark, range(100, 110)), 2)
    assert read_distinct(spark, out).first()[0] == 30


def test_no_sketch_and_only_nulls(spark):
    out = scratch_path(spark, "sketches")
    assert read_distinct(spark, out).first()[0] == 0
    sketch_writer(out, "email")(emails(spark, [None]), 0)
    assert read_distinct(spark, out).first()[0] == 0
