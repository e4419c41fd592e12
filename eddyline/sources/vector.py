"""Vector files: the rings of GeoJSON polygons as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POLYGON = "array<array<array<double>>>"
_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def rings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(region, ring: array<struct<x, y>>) of the polygons in GeoJSON files; ``name`` is the property that names a region.

    Parts of a region, and holes in it, are rings of one name: by the even-odd rule that is all that a mask needs.
    """
    files = spark.read.text(path, wholetext=True)
    feature = files.select(F.explode(F.from_json("value", _FEATURES)["features"]).alias("f")).select(F.col("f.properties")[name].alias("region"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("at"))
    one = F.array(F.from_json("at", _POLYGON))
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", F.from_json("at", f"array<{_POLYGON}>"))
    ring = feature.select("region", F.explode(F.flatten(parts)).alias("ring"))
    return ring.select("region", F.transform("ring", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("ring"))
