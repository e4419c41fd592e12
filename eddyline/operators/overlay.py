"""Events over a period, regions, and numbers for drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import Axis
from eddyline.sources.raster import dense


def events_in(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Event cells of a period, each with its event's serial as ``value``."""
    return cells.where(F.col("t").between(first, last)).select("t", "yi", "xi", F.col("serial").cast("long").alias("value"))


def period_overlay(cells: DataFrame, first: int, last: int, height: int, width: int) -> DataFrame:
    """Every cell of every day with the sum of the serials of the events there; 0 for none."""
    total = events_in(cells, first, last).groupBy("t", "yi", "xi").agg(F.sum("value").alias("value"))
    return dense(total, first, last, height, width)


def masked(raster: DataFrame, mask: DataFrame, land: int = 2) -> DataFrame:
    """Values over land (flag ``land`` in mask(yi, xi, mask)) become null. The mask has one row a cell of one grid."""
    joined = raster.join(mask.select("yi", "xi", "mask"), ["yi", "xi"], "left")
    return joined.withColumn("value", F.when(F.coalesce(F.col("mask") == land, F.lit(False)), None).otherwise(F.col("value"))).drop("mask")


def in_region(raster: DataFrame, region: DataFrame) -> DataFrame:
    return raster.join(region.select("yi", "xi").distinct(), ["yi", "xi"], "left_semi")


def dissolved(regions: DataFrame, codes: list[str]) -> DataFrame:
    """The cells (yi, xi) of some regions (region, yi, xi) together."""
    return regions.where(F.col("region").isin(codes)).select("yi", "xi").distinct()


def _edges(rings: DataFrame) -> DataFrame:
    """(region, x1, y1, x2, y2) of closed rings."""
    edge = F.explode(F.transform(F.sequence(F.lit(1), F.size("ring")), lambda i: F.struct(F.element_at("ring", i).alias("p"), F.element_at("ring", F.when(i == F.size("ring"), 1).otherwise(i + 1)).alias("q"))))
    return rings.select("region", edge.alias("e")).select("region", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def touched_cells(rings: DataFrame, x0: float, dx: float, y0: float, dy: float, height: int, width: int) -> DataFrame:
    """(region, yi, xi) of the cells that a ring's edges go through: cells are dx by dy around centres from (x0, y0). Each edge is cut into the rows that it spans, each part into columns."""
    scaled = _edges(rings).select("region", *(((F.col(c) - o) / d).alias(c) for c, o, d in (("x1", x0, dx), ("x2", x0, dx), ("y1", y0, dy), ("y2", y0, dy))))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = scaled.withColumns({"low": low, "high": high}).withColumn("yi", F.explode(F.sequence(F.floor(F.col("low") + 0.5).cast("int"), F.floor(F.col("high") + 0.5).cast("int"))))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    first, last = at(F.greatest("low", F.col("yi") - 0.5)), F.when(F.col("y1") == F.col("y2"), F.col("x2")).otherwise(at(F.least("high", F.col("yi") + 0.5)))
    columns = F.sequence(F.floor(F.least(first, last) + 0.5).cast("int"), F.floor(F.greatest(first, last) + 0.5).cast("int"))
    cells = rows.select("region", "yi", F.explode(columns).alias("xi"))
    return cells.where(F.col("yi").between(0, height - 1) & F.col("xi").between(0, width - 1)).distinct()


def _numbers(low, high, a: Axis):
    """The numbers of an axis' cells whose coordinates may lie between two columns, and a cell more on either side: what holds exactly is asked afterwards."""
    at = lambda c, beyond: F.least(F.lit(a.size - 1), F.greatest(F.lit(0), F.floor((c - a.start) / a.step) + beyond)).cast("int")
    return F.sequence(at(low, -1), at(high, 1))


def polygon_cells(rings: DataFrame, lat: Axis, lon: Axis) -> DataFrame:
    """(region, yi, xi) of the cells of a grid whose centres lie inside rings (region, ring: array<struct<x, y>>), by the even-odd rule.

    Row by row: an edge is cut by the rows that it spans; a row's cuts, sorted, begin and end the stretches inside, which are given out whole.
    No point is held against an edge, and nothing is joined: work is in proportion to the cuts and the cells inside.
    """
    if not lat.size or not lon.size:
        return rings.select("region", F.lit(0).alias("yi"), F.lit(0).alias("xi")).where("false")
    edges = _edges(rings).where("y1 <> y2").withColumns({"low": F.least("y1", "y2"), "high": F.greatest("y1", "y2")})
    rows = edges.withColumn("yi", F.explode(_numbers(F.col("low"), F.col("high"), lat))).withColumn("y", F.lit(float(lat.start)) + F.col("yi") * F.lit(float(lat.step)))
    crossing = rows.where("y >= low and y < high").select("region", "yi", (F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("cut"))
    # A row's cuts are as many as a region has edges there.
    cuts = crossing.groupBy("region", "yi").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(cuts) div 2") - 1), lambda i: F.struct(F.get("cuts", 2 * i).alias("a"), F.get("cuts", 2 * i + 1).alias("b")))
    spans = cuts.select("region", "yi", F.explode(pairs).alias("s")).select("region", "yi", "s.a", "s.b")
    cells = spans.withColumn("xi", F.explode(_numbers(F.col("a"), F.col("b"), lon))).withColumn("x", F.lit(float(lon.start)) + F.col("xi") * F.lit(float(lon.step)))
    return cells.where("x >= a and x < b").select("region", "yi", "xi")


def aligned(cells: DataFrame, raster: DataFrame) -> DataFrame:
    """Event cells with the value of the same day and place."""
    return cells.join(raster.select("t", "yi", "xi", "value"), ["t", "yi", "xi"], "left")


def centroids(cells: DataFrame, *keys: str) -> DataFrame:
    """The mean row and column of each group of cells, cut to whole numbers."""
    return cells.groupBy(*keys).agg(F.avg("yi").cast("int").alias("cy"), F.avg("xi").cast("int").alias("cx"))


def label_places(cells: DataFrame, height: int, width: int, *keys: str) -> DataFrame:
    """Where a group's name is drawn: its mean row and column, kept off the edges by a tenth of the width at the sides and a twentieth of it above and below, then rounded (halves to even)."""
    x, y = width // 10, width // 20
    clamp = lambda c, pad, size: F.rint(F.least(F.lit(float(size - pad)), F.greatest(F.lit(float(pad)), F.avg(c)))).cast("int")
    return cells.groupBy(*keys).agg(clamp("yi", y, height).alias("cy"), clamp("xi", x, width).alias("cx"))


def value_range(raster: DataFrame, n: float = 1.0) -> DataFrame:
    """mean, spread (population), low and high (mean -/+ n spreads), least and largest value; nulls don't count."""
    mean, spread = F.avg("value"), F.stddev_pop("value")
    return raster.agg(mean.alias("mean"), spread.alias("spread"), (mean - n * spread).alias("low"), (mean + n * spread).alias("high"), F.min("value").alias("least"), F.max("value").alias("largest"))


def frame_levels(raster: DataFrame) -> DataFrame:
    """Values as 0..255 of their day's largest: an aggregation by day and a join with it, which AQE broadcasts or splits, so a day is never one task's work."""
    top = raster.groupBy("t").agg(F.max("value").alias("__top"))
    level: Column = F.when(F.col("__top") > 0, F.floor(F.col("value") / F.col("__top") * 255)).otherwise(0)
    return raster.join(top, "t").withColumn("level", level.cast("int")).drop("__top")
