"""A1: relational table reads.

Parquet is the default storage; the JDBC form is what a deployment against
the original PostgreSQL schema uses.  Both return plain lazy DataFrames, so
filters and projections written later reach the scan (parquet:
``PushedFilters``/``ReadSchema``; JDBC: pushed ``WHERE``/column list).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one table stored as parquet below ``base`` (file or folder)."""
    path = os.path.join(base, f"{name}.parquet")
    return spark.read.parquet(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, *, properties: dict | None = None,
                    partition_column: str | None = None, lower_bound: int | None = None,
                    upper_bound: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Parallel JDBC read: one query per partition over ``partition_column`` ranges.

    Without a partition column a JDBC read is a single task, so large fact
    tables must pass one (e.g. ``order_id``).
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 64)))
    return reader.load()


# The original database's schema name and tables (schema ``food_ordering``), and the columns the
# operators read; ``riders.password`` is never loaded.
ORDER_TABLES = {
    "orders_status": ("order_id", "status", "rider_id", "event_timestamp"),
    "orders": ("order_id", "user_id", "total_amount", "status", "delivery_city", "delivery_instructions",
               "order_created_timestamp"),
    "users": ("user_id", "email", "phone_number", "city", "registration_date"),
    "menu_items": ("item_id", "name", "description", "price", "category", "date_added"),
    "order_details": ("order_id", "item_id", "quantity", "subtotal"),
    "riders": ("rider_id", "name", "phone_number", "vehicle_type", "vehicle_registration"),
}

# Large tables are read in parallel ranges of their key.
_PARTITION_KEYS = {"orders_status": "order_id", "orders": "order_id", "order_details": "order_id",
                   "users": "user_id"}


def _key_bounds(spark: SparkSession, url: str, table: str, key: str, properties: dict) -> tuple[int, int] | None:
    """Least and greatest key, one row computed by the database; ``None`` for a table without keys."""
    row = read_jdbc_table(spark, url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {table}) bounds",
                          properties=properties).first()
    return None if row is None or row["lo"] is None else (row["lo"], row["hi"])


def read_order_tables_jdbc(spark: SparkSession, url: str, properties: dict, *,
                           schema: str = "food_ordering", key_bounds: dict | None = None,
                           num_partitions: int = 64) -> dict[str, DataFrame]:
    """Open the original relational tables over JDBC as lazy DataFrames.

    The four large tables are read in ``num_partitions`` ranges of their key.
    ``key_bounds`` maps a table to ``(lower, upper)``; for a table it does not
    name the database is asked for them. Bounds only place the ranges: rows
    outside them, or without a key, are read all the same.
    """
    out = {}
    for name, cols in ORDER_TABLES.items():
        table, key = f"{schema}.{name}", _PARTITION_KEYS.get(name)
        bounds = key and ((key_bounds or {}).get(name) or _key_bounds(spark, url, table, key, properties))
        ranges = {"partition_column": key, "lower_bound": bounds[0], "upper_bound": bounds[1],
                  "num_partitions": num_partitions} if bounds else {}
        out[name] = read_jdbc_table(spark, url, table, properties=properties, **ranges).select(*cols)
    return out


def read_order_tables_lake(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The same tables from a parquet lake: ``<base>/<table>/`` folders.

    ``orders_status`` is expected partitioned by ``event_date``
    (``layout.write_event_log``), which the day/year slices prune on.
    """
    return {name: spark.read.parquet(os.path.join(base, name)) for name in ORDER_TABLES}
