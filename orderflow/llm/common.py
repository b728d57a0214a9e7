"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept (``lower`` alone would also map É, İ, ...)."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def size_or_zero(c: Column | str) -> Column:
    """Items of an array, 0 for null; outside ANSI mode ``size`` gives -1 for null."""
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage at a table that outlives any executor, and lets several
    branches read one result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` as it is.

    The rows are counted before the hint is given; larger sides are left to
    the shuffle joins that AQE plans and splits.  ``df`` should be cheap to
    read (materialised).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def least_by_hash(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """``rows`` (group, key) of the ``k`` least hashes of ``key`` in each group, with their rank ``k``; equal rows are one.

    A group's size gives a hash below which some more than ``k`` of its rows must lie, so that only those are ranked,
    however many rows a group has; if too few do after all, the bound is doubled.
    """
    rows = rows.select(group, key).distinct()
    sizes = {r[group]: r.n for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}  # a row per group
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    place = F.xxhash64(key) / 2.0 ** 64 + 0.5
    wanted = k + 8 * math.sqrt(k) + 50
    while True:
        bound = F.lit(0.0)
        for value, n in sizes.items():
            bound = F.when(F.col(group) == value, min(1.0, wanted / n)).otherwise(bound)
        ranked = materialise(rows.where(place <= bound).withColumn("k", rank).where(F.col("k") <= k), "least-by-hash")
        found = {r[group]: r.n for r in ranked.groupBy(group).agg(F.count("*").alias("n")).collect()}
        if all(found.get(value, 0) >= min(k, n) for value, n in sizes.items()):
            return ranked
        wanted *= 2


def learnable(doc_id: Column, modulus: int, held_out: int) -> Column:
    """True for rows outside the held-out fold ``crc32(doc_id as text) mod modulus = held_out``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus != held_out, F.lit(False))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows of that fold; a null id is in no fold: it is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


_KEPT: dict = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by this Python worker from task to task until another key is asked for.

    Workers outlive an operator's tasks; one store at a time keeps a job of
    several operators within the memory of one.
    """
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]


def release_memory() -> None:
    """Give what this Python worker has freed back to the system.

    A worker lives on for the next operator's tasks, and allocators keep
    freed batches: without this its size stays that of its largest task.
    """
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows go to Python workers in the jobs run inside; the session's own size comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    spark.conf.set(name, str(min(own, rows) if own > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(own))
