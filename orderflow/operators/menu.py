"""Menu (A2-A4, H1-H3)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.stats import round6


def menu_full(menu: DataFrame) -> DataFrame:
    """A2."""
    return menu.select("*")


def menu_listing(menu: DataFrame) -> DataFrame:
    """A3: the order form's item list."""
    return menu.select("item_id", "name", "category")


def menu_by_kind(menu: DataFrame) -> DataFrame:
    """A4: drinks vs everything else (a NULL category lands with food, like the form's test)."""
    return menu.select("item_id", "name", "category",
                       F.when(F.col("category") == "Drink", "drink").otherwise("food").alias("kind"))


def category_counts(menu: DataFrame) -> DataFrame:
    """H1: items per category, NULL categories dropped, largest first."""
    return (menu.filter(F.col("category").isNotNull())
            .groupBy("category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "category"))


def price_counts(menu: DataFrame) -> DataFrame:
    """H2: items per price."""
    return menu.groupBy("price").agg(F.count(F.lit(1)).alias("count"))


def price_density(menu: DataFrame, points: int = 500) -> DataFrame:
    """H3: Gaussian kernel density of prices on ``points`` grid points.

    Same estimator as the dashboard's density curve: Scott bandwidth
    ``h = stddev_samp * n ** -0.2``, grid ``min + k * (max - min) / points``.

    Distributed as a partial sum: prices are first reduced to distinct
    values with counts; each task adds its values' kernel mass to the fixed
    grid in one numpy batch and emits one partial row per grid point; the
    partials are summed per grid point.  Work is distinct prices x points,
    spread over the tasks; no pair is ever a row.
    """
    x = menu.select(F.col("price").cast("double").alias("x")).filter(F.col("x").isNotNull())
    st = x.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"),
                        (F.stddev_samp("x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2)))
                        .alias("h")).alias("s")).scalar()
    # The one-row statistics enter once, as a column of the distinct prices,
    # and travel with the partial sums to the final step.
    distinct = (x.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
                .select("x", "c", st.alias("s")).select("x", "c", "s.*"))

    def partial_sums(batches):
        grid_k = np.arange(points)
        for pdf in batches:
            if pdf.empty:
                continue
            lo, hi, h = float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0]), float(pdf["h"].iloc[0])
            grid = lo + grid_k * (hi - lo) / points
            acc = np.zeros(points)
            xs, cs = pdf["x"].to_numpy(), pdf["c"].to_numpy(dtype="float64")
            for i in range(0, len(xs), 2048):  # bound the temporary matrix
                z = (grid[None, :] - xs[i:i + 2048, None]) / h
                acc += (cs[i:i + 2048, None] * np.exp(-0.5 * z * z)).sum(axis=0)
            yield pd.DataFrame({"point": grid_k.astype("int32"), "s": acc, "lo": lo, "hi": hi,
                                "n": int(pdf["n"].iloc[0]), "h": h})

    sums = (distinct.mapInPandas(partial_sums, "point int, s double, lo double, hi double, n long, h double")
            .groupBy("point").agg(F.sum("s").alias("s"), *[F.any_value(c).alias(c) for c in ("lo", "hi", "n", "h")]))
    lo, hi, n, h = (F.col(k) for k in ("lo", "hi", "n", "h"))
    gx = lo + (F.col("point") * (hi - lo)) / points
    dens = F.col("s") / (n * h * math.sqrt(2 * math.pi))
    return sums.select("point", round6(gx).alias("x"), round6(dens).alias("density"))
