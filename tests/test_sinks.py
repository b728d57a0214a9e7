"""Sinks under replay: relational appends with commit records, changelogs merged into a base."""

import sqlite3

import pytest

from orderflow.session import list_folder, scratch_path
from orderflow.streaming import sinks
from orderflow.streaming.sinks import RelationalSink, changelog_batch, compact_changelog, read_latest


class StandIn:
    """A database that only this process sees, with a switch that lets a step fail."""

    def __init__(self):
        self.db = sqlite3.connect(":memory:", isolation_level="DEFERRED")
        self.db.execute('CREATE TABLE orders (id INTEGER, "user name" TEXT)')
        self.fails = None
        self.loads = 0

    def connect(self):
        return self

    def execute(self, sql):
        if self.fails and sql.startswith(self.fails):
            raise RuntimeError("the connection is gone")
        return self.db.execute(sql).fetchall()

    def commit(self):
        if self.fails == "commit" and self.db.in_transaction:
            raise RuntimeError("the connection is gone")
        self.db.commit()

    def rollback(self):
        self.db.rollback()

    def close(self):
        self.db.rollback()

    def load(self, df, table):
        self.loads += 1
        self.db.execute(f"DROP TABLE IF EXISTS {table}")
        self.db.execute(f'CREATE TABLE {table} (id INTEGER, "user name" TEXT)')
        rows = [tuple(r) for r in df.collect()]
        half = rows[: len(rows) // 2] if self.fails == "load" else rows
        self.db.executemany(f"INSERT INTO {table} VALUES (?, ?)", half)
        self.db.commit()
        if self.fails == "load":
            raise RuntimeError("an executor is gone")

    def rows(self):
        return sorted(self.db.execute("SELECT * FROM orders").fetchall())


def frame(spark, ids):
    return spark.createDataFrame([(i, f"u{i}") for i in ids], ["id", "user name"])


@pytest.mark.parametrize("fails", ["load", "INSERT INTO sink_commits", "INSERT INTO orders", "commit", "CREATE"])
def test_a_failed_attempt_and_its_replay_append_once(spark, fails):
    db = StandIn()
    sink = RelationalSink("orders", "it's a feed", db.connect, db.load)
    assert sink.append(frame(spark, [1, 2]), 0)
    db.fails = fails
    with pytest.raises(RuntimeError):
        sink.append(frame(spark, [3, 4, 5]), 1)
    db.fails = None
    db.db.rollback()
    assert [r[0] for r in db.rows()] == [1, 2]
    assert sink.append(frame(spark, [3, 4, 5]), 1)
    assert not sink.append(frame(spark, [3, 4, 5]), 1)  # replayed after its commit
    assert [r[0] for r in db.rows()] == [1, 2, 3, 4, 5]


def test_sinks_of_other_names_have_their_own_epochs(spark):
    db = StandIn()
    for name in ("a", "b"):
        assert RelationalSink("orders", name, db.connect, db.load).append(frame(spark, [7]), 0)
    assert db.rows() == [(7, "u7"), (7, "u7")]


def test_jdbc_batches_go_through_the_sink(spark, monkeypatch):
    db = StandIn()
    monkeypatch.setattr(sinks, "jdbc_sink", lambda s, table, name, options: RelationalSink(table, name, db.connect, db.load)
                        if options == {"url": "jdbc:x"} else None)
    for _ in range(2):
        sinks.append_batch(frame(spark, [1]), 4, "orders", fmt="jdbc", jdbc={"url": "jdbc:x", "sink": "s"})
    assert db.rows() == [(1, "u1")] and db.loads == 1


def epochs_of(spark, n):
    """Epoch e writes keys e, e + 1, e + 2 with the value 10 e + key."""
    want = {}
    for e in range(n):
        rows = [(k, 10 * e + k) for k in range(e, e + 3)]
        want |= dict(rows)
        yield e, spark.createDataFrame(rows, "k long, v long"), dict(want)


def latest(spark, table):
    return {r.k: r.v for r in read_latest(spark, table, ["k"]).collect()}


def test_a_changelog_is_merged_into_its_base(spark):
    table = scratch_path(spark, "changelog")
    for e, df, want in epochs_of(spark, 8):
        for _ in range(2):  # every epoch is replayed once
            changelog_batch(df, e, table, ["k"], compact_after=3)
            assert latest(spark, table) == want
        assert len([n for n in list_folder(spark, table) if n.startswith("epoch=")]) <= 4
    assert len([n for n in list_folder(spark, table + "-base") if n.startswith("upto=")]) == 1


@pytest.mark.parametrize("dies", ["write", "delete"])
def test_a_crash_while_merging_changes_nothing(spark, monkeypatch, dies):
    table = scratch_path(spark, "changelog")
    for e, df, want in epochs_of(spark, 5):
        changelog_batch(df, e, table)
    if dies == "write":  # a base without its commit
        spark.range(1).selectExpr("id AS k", "id AS v").write.parquet(f"{table}-base/upto=3")
        from orderflow.session import delete_folder
        delete_folder(spark, f"{table}-base/upto=3/_SUCCESS")
    else:
        def fail(*_):
            raise RuntimeError("the driver is gone")
        with monkeypatch.context() as m:
            m.setattr(sinks, "delete_folder", fail)
            with pytest.raises(RuntimeError):
                compact_changelog(spark, table, ["k"], 4, 2)
    assert latest(spark, table) == want
    compact_changelog(spark, table, ["k"], 4, 2)
    assert latest(spark, table) == want
    assert sorted(n for n in list_folder(spark, table) if n.startswith("epoch=")) == ["epoch=4"]
