"""Per-micro-batch sinks for ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import delete_folder, list_folder


def append_batch(df: DataFrame, epoch_id: int, table: str, *, fmt: str = "parquet",
                 jdbc: dict | None = None) -> None:
    """Append one micro-batch to a table, idempotently.

    Parquet: the batch goes to ``<table>/epoch_id=<n>`` with overwrite, so a
    batch replayed after a failure replaces its own earlier attempt instead
    of duplicating rows. JDBC: staged and published with a commit record
    (``RelationalSink``); ``jdbc`` holds the connection's options, with ``url``
    and perhaps ``sink``, the name that the commit records carry.
    """
    if fmt == "jdbc":
        options = dict(jdbc or {})
        name = options.pop("sink", table)
        jdbc_sink(df.sparkSession, table, name, options).append(df, epoch_id)
        return
    df.write.mode("overwrite").format(fmt).save(f"{table}/epoch_id={epoch_id}")


@dataclass
class RelationalSink:
    """Replay-safe appends to a relational table.

    An epoch's rows are loaded into a staging table, in parallel and with overwrite; then one transaction on the driver
    records (sink, epoch) and inserts the staged rows. An attempt that dies while loading leaves only staging, which the
    replay overwrites. One that dies after the commit leaves its record, and the replay does nothing. Two attempts
    at once can't both commit: the record is the primary key.

    ``connect`` opens a connection with ``execute(sql)`` (the rows of a SELECT), ``commit``, ``rollback`` and ``close``;
    ``load(df, table)`` writes a frame to a table that it replaces.
    """

    table: str
    name: str
    connect: Callable[[], Any]
    load: Callable[[DataFrame, str], None]
    commits: str = "sink_commits"

    def append(self, df: DataFrame, epoch_id: int) -> bool:
        """Append one epoch; False if it was there already."""
        name = self.name.replace("'", "''")
        staging, columns = f"{self.table}_staging", ", ".join(f'"{c}"' for c in df.columns)
        connection = self.connect()
        try:
            connection.execute(f"CREATE TABLE IF NOT EXISTS {self.commits} "
                               "(sink VARCHAR(200) NOT NULL, epoch BIGINT NOT NULL, PRIMARY KEY (sink, epoch))")
            connection.commit()
            done = list(connection.execute(f"SELECT epoch FROM {self.commits} WHERE sink = '{name}' AND epoch = {int(epoch_id)}"))
            connection.commit()
            if done:
                return False
            self.load(df, staging)
            try:
                connection.execute(f"INSERT INTO {self.commits} (sink, epoch) VALUES ('{name}', {int(epoch_id)})")
                connection.execute(f"INSERT INTO {self.table} ({columns}) SELECT {columns} FROM {staging}")
                connection.commit()
            except Exception:
                connection.rollback()
                raise
            return True
        finally:
            connection.close()


class _JdbcConnection:
    """A ``java.sql.Connection`` of the driver's JVM in the form that ``RelationalSink`` uses."""

    def __init__(self, spark: SparkSession, options: dict) -> None:
        properties = spark._jvm.java.util.Properties()
        for k, v in options.items():
            if k not in ("url", "driver"):
                properties.setProperty(k, str(v))
        if "driver" in options:
            spark._jvm.java.lang.Class.forName(options["driver"])
        self.connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], properties)
        self.connection.setAutoCommit(False)

    def execute(self, sql: str) -> list:
        statement = self.connection.createStatement()
        try:
            rows = []
            if statement.execute(sql):
                result = statement.getResultSet()
                while result.next():
                    rows.append((result.getObject(1),))
            return rows
        finally:
            statement.close()

    def commit(self) -> None:
        self.connection.commit()

    def rollback(self) -> None:
        self.connection.rollback()

    def close(self) -> None:
        self.connection.close()


def jdbc_sink(spark: SparkSession, table: str, name: str, options: dict) -> RelationalSink:
    """The sink over JDBC: one connection a partition loads the staging table, one on the driver publishes it."""

    def load(df: DataFrame, staging: str) -> None:
        df.write.format("jdbc").options(**{k: str(v) for k, v in options.items()}).option("dbtable", staging) \
            .mode("overwrite").save()

    return RelationalSink(table, name, lambda: _JdbcConnection(spark, options), load)


#: Epochs that a changelog gathers before they are merged into its base.
COMPACT_AFTER = 16


def _committed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of the folders ``<path>/<prefix>=<n>`` whose job has committed, ascending."""
    names = [n for n in list_folder(spark, path) or [] if n.startswith(prefix + "=")]
    return sorted(int(n.partition("=")[2]) for n in names if "_SUCCESS" in (list_folder(spark, f"{path}/{n}") or []))


def changelog_batch(df: DataFrame, epoch_id: int, table: str, keys: list[str] | None = None,
                    compact_after: int = COMPACT_AFTER) -> None:
    """Update-mode sink: the rows changed in this micro-batch, tagged with the epoch.

    Only changed keys are written (never the whole result), and replaying an
    epoch overwrites its own folder.  ``read_latest`` merges on read. With
    ``keys``, earlier epochs are merged into a base whenever there are
    ``compact_after`` of them, so that reading stays in proportion to the keys.
    """
    df.write.mode("overwrite").parquet(f"{table}/epoch={epoch_id}")
    if keys:
        compact_changelog(df.sparkSession, table, keys, epoch_id, compact_after)


def compact_changelog(spark: SparkSession, table: str, keys: list[str], epoch_id: int, at_least: int = COMPACT_AFTER) -> bool:
    """Merge the epochs below ``epoch_id`` into ``<table>-base/upto=<n>`` if there are ``at_least`` of them.

    The epoch at hand may be replayed and stays. The new base counts once its job has committed; what it holds is
    deleted only then, and readers pass over epochs that a base holds. So a crash before, between or after leaves
    the same content, and the next call clears what is left over.
    """
    bases = _committed(spark, table + "-base", "upto")
    base = bases[-1] if bases else -1
    epochs = [e for e in _committed(spark, table, "epoch") if e < epoch_id]
    merged = sum(e > base for e in epochs) >= at_least
    if merged:
        new = max(epochs)
        (_latest(spark, table, keys, base, [e for e in epochs if e > base])
         .write.mode("overwrite").parquet(f"{table}-base/upto={new}"))
        bases, base = [*bases, new], new
    for e in epochs:
        if e <= base:
            delete_folder(spark, f"{table}/epoch={e}")
    for b in bases:
        if b < base:
            delete_folder(spark, f"{table}-base/upto={b}")
    return merged


def _latest(spark: SparkSession, table: str, keys: list[str], base: int, epochs: list[int]) -> DataFrame:
    parts = [(f"{table}-base/upto={base}", base)] if base >= 0 else []
    parts += [(f"{table}/epoch={e}", e) for e in epochs]
    log = reduce(DataFrame.unionByName, [spark.read.parquet(p).withColumn("__epoch", F.lit(e).cast("long")) for p, e in parts])
    vals = [c for c in log.columns if c not in keys and c != "__epoch"]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("__epoch")).alias("v"))
    return latest.select(*keys, *[F.col("v")[c].alias(c) for c in vals])


def read_latest(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Current value per key of a changelog table: the row of the highest epoch, over the newest base.

    ``max_by`` is a partial aggregate, so the merge combines map-side.
    """
    if not keys:
        raise ValueError("a changelog needs the key columns of its groups")
    bases = _committed(spark, table + "-base", "upto")
    base = bases[-1] if bases else -1
    return _latest(spark, table, keys, base, [e for e in _committed(spark, table, "epoch") if e > base])


def debug_console(stream: DataFrame, rows: int = 20):
    """Print each micro-batch to the driver log (debugging only; never a data sink)."""
    return (stream.writeStream.format("console").option("numRows", rows).option("truncate", False)
            .outputMode("append"))
