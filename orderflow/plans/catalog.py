"""Query registry used by ``__spark_entry__`` and ``bench.py``.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle, when the result
is expressible in plain SQL, is written independently of the plan (DuckDB
dialect; several in closed form, see ``closed_form``) and gets the fixture views
it refers to prepended as CTEs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderflow.plans.fixture_sql import with_fixtures
from orderflow.sources.fixtures import Fixtures

# Fixed parameters of the registered queries (the fixture's reporting day,
# year, rider and date range; the denial quorum of the original system).
AS_OF = dt.date(1998, 6, 15)
YEAR = 1998
RIDER = 1
RIDER_NAME = "Supplier#000000002"
N = 3

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
ORACLE_RAW: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if oracle is not None:
            ORACLE_RAW[name] = oracle
            ORACLE[name] = with_fixtures(oracle)
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


def load_all() -> None:
    """Import every module that registers queries."""
    from orderflow.plans import dashboards, feeds, history_days, orderlog, streams  # noqa: F401
