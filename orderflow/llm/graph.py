"""Connected components of a graph that is given as edges, by large and small stars.

Each round links every node's larger neighbours to its least neighbour, then
every node's smaller neighbours likewise, until each component is one star
around its least node.  Only minima are aggregated (map-side first) and
joined back, so a node with very many neighbours is a skewed inner join and
never one group.  Every round is written to the shared folder, which cuts the
lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of an edge, label being the least node of its component.

    Self-loops and repeated edges are allowed; an empty edge table gives an
    empty result.
    """
    now = materialise(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                      .where("u <> v").distinct(), "edges")  # u > v throughout
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = materialise(small.select("u", F.col("m").alias("v"))
                          .union(small.select("v", "m").where("v <> m")).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")) \
        .union(now.select("v", "v").distinct())
