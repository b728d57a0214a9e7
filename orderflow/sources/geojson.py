"""GeoJSON LineString routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow import schemas


def read_route(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read FeatureCollection documents with an explicit schema.

    ``multi_line=True`` reads one pretty-printed document per file (the
    original's route file); ``False`` reads one document per line.
    """
    return spark.read.schema(schemas.GEOJSON).option("multiLine", multi_line).json(path)


def route_points(geo: DataFrame) -> DataFrame:
    """One row per route vertex: feature index, point index, lat = c[1], lon = c[0]."""
    return feature_points(geo).drop("properties")


def feature_points(geo: DataFrame) -> DataFrame:
    """``route_points`` with each vertex's feature ``properties``."""
    f = geo.select(F.posexplode("features").alias("feature", "f"))
    return (f.select("feature", F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("c"))
            .select("feature", "properties", F.posexplode("c").alias("point", "xy"))
            .select("feature", "properties", "point", F.col("xy")[1].alias("latitude"), F.col("xy")[0].alias("longitude")))


def routes_from_positions(positions: DataFrame, chunk: int = 1000) -> DataFrame:
    """Build LineString documents from a position table (test/derivation helper).

    One feature per (busline, block of ``chunk`` consecutive event ids), so a
    feature never holds more than ``chunk`` vertices however hot a line is.
    Vertices are ordered by (time, event id).
    """
    pts = positions.select("busline", (F.col("event_id") / chunk).cast("bigint").alias("block"),
                           F.struct("position_ts", "event_id", "longitude", "latitude").alias("p"))
    feats = (pts.groupBy("busline", "block")
             .agg(F.array_sort(F.collect_list("p")).alias("ps"))
             .select("busline", "block", F.struct(
                 F.lit("Feature").alias("type"),
                 F.create_map(F.lit("busline"), F.col("busline"),
                              F.lit("block"), F.col("block").cast("string")).alias("properties"),
                 F.struct(F.lit("LineString").alias("type"),
                          F.transform("ps", lambda p: F.array(p["longitude"], p["latitude"]))
                          .alias("coordinates")).alias("geometry")).alias("feature")))
    return feats.select("busline", "block", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                                               F.array("feature").alias("features"))).alias("doc"))
