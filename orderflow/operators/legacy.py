"""Legacy confirmed-order analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_orders(legacy: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` newest orders (NULL times first, as PostgreSQL's DESC does; id breaks ties).

    ``orderBy().limit()`` plans as a top-k (TakeOrderedAndProject): each task
    keeps its own k best rows, only k rows per task reach the final merge.
    """
    return legacy.orderBy(F.col("time").desc_nulls_first(), F.col("id")).limit(k)


def legacy_totals(legacy: DataFrame) -> DataFrame:
    """Active orders, order count and revenue (0 when there is none); a decimal cost keeps its cents."""
    money = "bigint" if legacy.schema["cost"].dataType.typeName() in ("integer", "long") else "decimal(38,2)"
    return legacy.agg(F.count(F.when(F.col("order_completed") == 0, 1)).alias("active_orders"),
                      F.count(F.lit(1)).alias("order_count"),
                      F.coalesce(F.sum("cost"), F.lit(0)).cast(money).alias("total_revenue"))


def transaction_lines(legacy: DataFrame) -> DataFrame:
    """The transaction log line per confirmed order."""
    # Fixed value: the line's wording must equal the original's.
    line = F.format_string("Order by: %s: %s (size %s). Cost: %s. Order time: %s",
                           F.col("username"), F.col("food"), F.col("size"), F.col("cost").cast("string"),
                           F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return legacy.select("id", line.alias("line"))


def unique_emails(legacy: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """I7 (batch form): distinct e-mails seen so far.

    ``approx=True`` uses a HyperLogLog++ sketch (``approx_count_distinct``,
    relative error ``rsd``): constant memory per task when the set of
    e-mails is too large to deduplicate exactly.
    """
    if approx:
        return legacy.agg(F.approx_count_distinct("email", rsd).alias("n_unique_emails"))
    return legacy.agg(F.countDistinct("email").alias("n_unique_emails"))
