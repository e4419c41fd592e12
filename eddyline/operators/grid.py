"""Grids: sinusoidal projection, resampling by weights, nearest cells.

Where the source cells of a target cell are, and with what weight, doesn't depend on
time: it is worked out once from the axes, and joined; Spark broadcasts it where its size allows.
The table has four rows for each target cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mean sphere, and the WGS 84 ellipsoid's semi-major axis and squared eccentricity.
SPHERE, AXIS, E2 = 6_371_000.0, 6_378_137.0, 0.00669437999014


def sinusoidal(lat: Column, lon: Column, ellipsoid: bool = True) -> tuple[Column, Column]:
    """x and y in metres of latitude and longitude in degrees (Snyder, USGS Professional Paper 1395)."""
    phi, lam = F.radians(lat), F.radians(lon)
    if not ellipsoid:
        return SPHERE * lam * F.cos(phi), SPHERE * phi
    x = AXIS * lam * F.cos(phi) / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    c0 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
    c2 = 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
    c4 = 15 * E2**2 / 256 + 45 * E2**3 / 1024
    y = AXIS * (c0 * phi - c2 * F.sin(2 * phi) + c4 * F.sin(4 * phi) - 35 * E2**3 / 3072 * F.sin(6 * phi))
    return x, y


def from_sinusoidal(x: Column, y: Column, ellipsoid: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude in degrees; on the ellipsoid by the rectifying latitude's series (same source)."""
    if not ellipsoid:
        phi = y / SPHERE
        return F.degrees(phi), F.degrees(x / (SPHERE * F.cos(phi)))
    mu = y / (AXIS * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    terms = (3 * e / 2 - 27 * e**3 / 32, 21 * e**2 / 16 - 55 * e**4 / 32, 151 * e**3 / 96, 1097 * e**4 / 512)
    phi = sum((c * F.sin(2 * (k + 1) * mu) for k, c in enumerate(terms)), mu)
    return F.degrees(phi), F.degrees(x * F.sqrt(1 - E2 * F.pow(F.sin(phi), 2)) / (AXIS * F.cos(phi)))


def axis(spark: SparkSession, start: float, stop: float, step: float, name: str) -> DataFrame:
    """({name}i, {name}) from start, below stop."""
    n = max(0, math.ceil((stop - start) / step - 1e-9))
    return spark.range(n).select(F.col("id").cast("int").alias(f"{name}i"), (F.lit(float(start)) + F.col("id") * float(step)).alias(name))


def projected_grid(bounds: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """The axes y and x of a regular grid over projected points (x, y): from the least value, below the largest."""
    spark = bounds.sparkSession
    x0, x1, y0, y1 = bounds.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    return axis(spark, y0, y1, cell, "y"), axis(spark, x0, x1, cell, "x")


def bilinear_weights(targets: DataFrame, lat0: float, lat_step: float, lon0: float, lon_step: float, height: int, width: int) -> DataFrame:
    """(yi, xi, src_yi, src_xi, weight) of targets (yi, xi, lat, lon) in a regular source grid; targets outside have none."""
    # To a thousand-millionth of a cell, so that what lies on an edge is inside, however it was computed.
    fy, fx = F.round((F.col("lat") - lat0) / lat_step, 9), F.round((F.col("lon") - lon0) / lon_step, 9)
    df = targets.select("yi", "xi", fy.alias("fy"), fx.alias("fx")).where(F.col("fy").between(0, height - 1) & F.col("fx").between(0, width - 1))
    sy, sx = F.least(F.floor("fy"), F.lit(max(0, height - 2))).cast("int"), F.least(F.floor("fx"), F.lit(max(0, width - 2))).cast("int")
    df = df.select("yi", "xi", sy.alias("sy"), sx.alias("sx"), (F.col("fy") - sy).alias("wy"), (F.col("fx") - sx).alias("wx"))
    corner = lambda dy, dx: F.struct(
        (F.col("sy") + dy).alias("src_yi"), (F.col("sx") + dx).alias("src_xi"), ((F.col("wy") if dy else 1 - F.col("wy")) * (F.col("wx") if dx else 1 - F.col("wx"))).alias("weight")
    )
    corners = F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)))
    return df.select("yi", "xi", corners.alias("c")).select("yi", "xi", "c.*").where("weight > 0")


def resampled(raster: DataFrame, weights: DataFrame) -> DataFrame:
    """(t, yi, xi, value): the weighted source values; null where a source cell is missing."""
    own = raster.select("t", F.col("yi").alias("src_yi"), F.col("xi").alias("src_xi"), "value")
    both = own.join(weights, ["src_yi", "src_xi"])
    total = F.sum("weight")
    return both.where(F.col("value").isNotNull()).groupBy("t", "yi", "xi").agg(F.when(total > 1 - 1e-9, F.sum(F.col("weight") * F.col("value"))).alias("value"))


def nearest_cells(targets: DataFrame, lat0: float, lat_step: float, lon0: float, lon_step: float, height: int, width: int) -> DataFrame:
    """(yi, xi, src_yi, src_xi) of the closest source cell of each target within the grid; ties go to the even cell."""
    sy, sx = F.rint((F.col("lat") - lat0) / lat_step).cast("int"), F.rint((F.col("lon") - lon0) / lon_step).cast("int")
    return targets.select("yi", "xi", sy.alias("src_yi"), sx.alias("src_xi")).where(F.col("src_yi").between(0, height - 1) & F.col("src_xi").between(0, width - 1))


def carried(labels: DataFrame, near: DataFrame) -> DataFrame:
    """Labels (t, yi, xi, label) on another grid, by nearest cell: labels are names, so they are never averaged."""
    own = labels.select("t", F.col("yi").alias("src_yi"), F.col("xi").alias("src_xi"), "label")
    return own.join(near, ["src_yi", "src_xi"]).select("t", "yi", "xi", "label")


def nearest_value(raster: DataFrame, at: str, where: float) -> DataFrame:
    """The rows whose coordinate ``at`` is the closest to a value (the smaller one of two)."""
    best = raster.agg(F.min(F.struct(F.abs(F.col(at) - where).alias("d"), F.col(at).alias("v"))).alias("m")).select(F.col("m.v").alias(at))
    return raster.join(F.broadcast(best), at, "left_semi")  # one row


def project(raster: DataFrame, places: DataFrame, lat0: float, lat_step: float, lon0: float, lon_step: float, height: int, width: int, cell: float, ellipsoid: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A lat/lon raster on the regular sinusoidal grid over its own projected cells, ``cell`` metres a step: (raster (t, yi, xi, value), axis (yi, y), axis (xi, x)).

    places: (lat, lon) of the source cells. Values are linear between source cells; null where one that counts is missing.
    """
    x, y = sinusoidal(F.col("lat"), F.col("lon"), ellipsoid)
    ys, xs = projected_grid(places.select(x.alias("x"), y.alias("y")), cell)
    lat, lon = from_sinusoidal(F.col("x"), F.col("y"), ellipsoid)
    # Every cell of one grid: its rows by its columns.
    weights = bilinear_weights(_cells(ys, xs).select("yi", "xi", lat.alias("lat"), lon.alias("lon")), lat0, lat_step, lon0, lon_step, height, width)
    return resampled(raster, weights), ys, xs


def _cells(ys: DataFrame, xs: DataFrame) -> DataFrame:
    """(yi, y, xi, x) of a grid from its axes, by one explode: the x axis is one short list."""
    n, first, last = xs.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).head()
    step = (last - first) / (n - 1) if n > 1 else 0.0
    return ys.withColumn("xi", F.explode(F.array_repeat(F.lit(0), n) if not n else F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", F.lit(first or 0.0) + F.col("xi") * F.lit(step))


def _at(places: DataFrame, ellipsoid: bool) -> DataFrame:
    """Lat/lon places (yi, xi, lat, lon) by where they lie in a projected grid: lat is their y, lon their x."""
    x, y = sinusoidal(F.col("lat"), F.col("lon"), ellipsoid)
    return places.select("yi", "xi", y.alias("lat"), x.alias("lon"))


def project_back(raster: DataFrame, places: DataFrame, y0: float, x0: float, cell: float, height: int, width: int, ellipsoid: bool = True) -> DataFrame:
    """A raster of the sinusoidal grid that starts at (y0, x0) on lat/lon places (yi, xi, lat, lon), linear."""
    return resampled(raster, bilinear_weights(_at(places, ellipsoid), y0, cell, x0, cell, height, width))


def labels_back(labels: DataFrame, places: DataFrame, y0: float, x0: float, cell: float, height: int, width: int, ellipsoid: bool = True) -> DataFrame:
    """Labels of the sinusoidal grid on lat/lon places, by the nearest cell."""
    return carried(labels, nearest_cells(_at(places, ellipsoid), y0, cell, x0, cell, height, width))


def affine(x0: float, dx: float, y0: float, dy: float) -> tuple[float, float, float, float, float, float]:
    """From cell numbers to the corners of cells whose centres are at x0, y0 and so on: (dx, 0, x, 0, dy, y)."""
    return dx, 0.0, x0 - dx / 2, 0.0, dy, y0 - dy / 2
