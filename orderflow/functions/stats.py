"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round6(c: Column) -> Column:
    """Doubles are reported rounded to 6 decimals so results are engine-stable."""
    return F.round(c.cast("double"), 6)


def share_of_total(df: DataFrame, value: str, alias: str = "share") -> DataFrame:
    """Append ``value / sum(value)`` over the whole frame.

    The total is a scalar subquery, so the frame keeps its partitioning (no
    window over a single partition, no join) and nothing is written: for an
    aggregated frame Spark reuses the aggregate's exchange for the total.
    """
    total = df.agg(F.sum(F.col(value)).cast("double").alias("t")).scalar()
    return df.withColumn(alias, round6(F.col(value).cast("double") / total))
