"""Rasters as long, sparse tables: t (days since 1970-01-01), yi, xi, value, and lat and lon where known."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.config import Axis

ALIASES = {"latitude": "lat", "longitude": "lon", "time": "date"}


def scan(spark: SparkSession, path: str, variable: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """A raster table, of one variable. Tables partitioned by ``year`` are pruned to the years asked for."""
    df = spark.read.parquet(path)
    df = df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns})
    if first_year is not None and "year" in df.columns:
        df = df.where(F.col("year").between(first_year, last_year if last_year is not None else first_year))
    t = F.col("t") if "t" in df.columns else F.unix_date(F.col("date").cast("date"))
    value = F.col(variable).cast("double")
    places = [F.col(c) for c in ("lat", "lon") if c in df.columns]
    return df.select(t.cast("int").alias("t"), "yi", "xi", *places, F.when(~F.isnan(value), value).alias("value"))


def load(spark: SparkSession, path: str, variable: str, first: int, last: int, area: tuple[float, float, float, float] | None = None, step: int = 1, axes: tuple[Axis, Axis] | None = None) -> DataFrame:
    """One variable of the days first..last, of an area (lat_min, lat_max, lon_min, lon_max), and every step-th row and column of it.

    Rows and columns count from the area's first, which ``axes`` (lat, lon) tell: a table has no row for a cell without a value, so
    what happens to be present on some days doesn't.
    """
    years = [(date(1970, 1, 1) + timedelta(days=t)).year for t in (first, last)]
    df = days(scan(spark, path, variable, *years), first, last)
    if area is not None:
        if axes is None:
            raise ValueError("an area's first row and column take the axes")
        df = box(df, *area)
        df = df.withColumns({name: (F.col(name) - axis.first(low)).cast("int") for name, axis, low in (("yi", axes[0], area[0]), ("xi", axes[1], area[2]))})
    return thinned(df, step) if step > 1 else df


def preprocessed(df: DataFrame, least: float, region: DataFrame | None = None) -> DataFrame:
    """The cells from the least value on, of a region (yi, xi) where one is given."""
    cells = mask(df.drop("category"), least)
    return cells if region is None else cells.join(region.select("yi", "xi").distinct(), ["yi", "xi"], "left_semi")


def days(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("t").between(first, last))


def box(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max))


def thinned(df: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column from the first; indices are counted anew."""
    kept = df.where((F.col("yi") % step == 0) & (F.col("xi") % step == 0))
    return kept.withColumns({c: F.expr(f"cast({c} div {step} as int)") for c in ("yi", "xi")})


def over(value: Column, least: float) -> Column:
    """1 from the least value on, else 0; null and NaN (which Spark sorts above all numbers) are 0."""
    return F.when(~F.isnan(value) & (value >= least), 1).otherwise(0)


def mask(df: DataFrame, least: float) -> DataFrame:
    """The cells from the least value on; others are absent."""
    return df.where(over(F.col("value"), least) == 1).select("t", "yi", "xi")


def spine(spark: SparkSession, first: int, last: int, height: int, width: int) -> DataFrame:
    """Every cell of every day, from one range: no join."""
    cells = height * width
    n = F.col("id")
    df = spark.range((last - first + 1) * cells)
    return df.select((F.lit(first) + F.expr(f"id div {cells}")).cast("int").alias("t"), F.expr(f"id % {cells} div {width}").cast("int").alias("yi"), (n % width).cast("int").alias("xi"))


def dense(df: DataFrame, first: int, last: int, height: int, width: int) -> DataFrame:
    """All cells, 0 where the table has none."""
    full = spine(df.sparkSession, first, last, height, width)
    return full.join(df.select("t", "yi", "xi", "value"), ["t", "yi", "xi"], "left").fillna(0, ["value"])


def blocks(df: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    """Block sums and counts (their ratio is the mean); a ragged edge is cut off, nulls don't count."""
    whole = df.where((F.col("yi") < height // factor * factor) & (F.col("xi") < width // factor * factor))
    at = [F.expr(f"cast({c} div {factor} as int)").alias(c) for c in ("yi", "xi")]
    return whole.groupBy("t", *at).agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.avg("value").alias("mean"))


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Each cell as times x times cells."""
    if times < 1:
        raise ValueError("a cell is repeated once or more")
    step = F.sequence(F.lit(0), F.lit(times - 1))
    out = df.withColumn("__dy", F.explode(step)).withColumn("__dx", F.explode(step))
    return out.withColumns({"yi": F.col("yi") * times + F.col("__dy"), "xi": F.col("xi") * times + F.col("__dx")}).drop("__dy", "__dx")


def smoothed(df: DataFrame, height: int, width: int, days_back: int) -> DataFrame:
    """Sums over 3 x 3 cells (clipped at the edges), then over each cell's last days. Sparse in and out: one aggregation."""
    step = F.sequence(F.lit(-1), F.lit(1))
    near = df.withColumn("__dy", F.explode(step)).withColumn("__dx", F.explode(step)).withColumn("__dt", F.explode(F.sequence(F.lit(0), F.lit(days_back))))
    near = near.select((F.col("t") + F.col("__dt")).cast("int").alias("t"), (F.col("yi") + F.col("__dy")).cast("int").alias("yi"), (F.col("xi") + F.col("__dx")).cast("int").alias("xi"), "value")
    near = near.where(F.col("yi").between(0, height - 1) & F.col("xi").between(0, width - 1))
    return near.groupBy("t", "yi", "xi").agg(F.sum("value").alias("value"))
