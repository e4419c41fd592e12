"""Results and state as Parquet tables: windows, events, label maps, lifetimes, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_windows(df: DataFrame, path: str) -> None:
    """One partition a window; windows written again replace their own only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(path)


def continues(old: DataFrame, new: DataFrame) -> None:
    """ValueError unless the new table's first day follows the old one's last."""
    last, first = old.agg(F.max("t")).head()[0], new.agg(F.min("t")).head()[0]
    if last is not None and first is not None and first != last + 1:
        raise ValueError(f"day {first} doesn't follow day {last}")


def append(df: DataFrame, path: str) -> None:
    """Append days to a table that they continue."""
    spark = df.sparkSession
    if _exists(spark, path):
        continues(spark.read.parquet(path), df)
    df.write.mode("append").parquet(path)


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two stretches of time over the same axes; ValueError where an axis differs."""
    for axis in ("yi", "xi"):
        one, two = a.select(axis).distinct(), b.select(axis).distinct()
        if not one.join(two, axis, "left_anti").isEmpty() or not two.join(one, axis, "left_anti").isEmpty():
            raise ValueError(f"the {axis} axes differ")
    return a.unionByName(b)


def save_events(events: DataFrame, cells: DataFrame, path: str) -> None:
    """Events and their cells, both in folders by the year in which the event began: it is part of an id."""
    year = F.substring_index("id", "_", -1).cast("int")
    for name, df in (("events", events), ("event_cells", cells)):
        df.withColumn("year", year).write.mode("overwrite").partitionBy("year").parquet(f"{path}/{name}")


def load_event(spark: SparkSession, path: str, id: str) -> DataFrame:
    """An event's cells; only its year's folder is read."""
    return spark.read.parquet(f"{path}/event_cells").where((F.col("year") == int(id.rpartition("_")[2])) & (F.col("id") == id))


def named(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The tables of a folder whose names fit, together, with each row's as ``name``."""
    return spark.read.parquet(f"{path}/{glob}").withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -2))


def newest_year(df: DataFrame) -> DataFrame:
    """The rows of the latest ``year``."""
    return df.join(df.agg(F.max("year").alias("year")), "year", "left_semi")


def save_state(df: DataFrame, path: str, version: int) -> None:
    """State (label map, lifetimes, overlap) by version; older versions stay as a backup."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of some state, the latest by default."""
    df = spark.read.option("basePath", path).parquet(path)
    version = df.agg(F.max("version")).head()[0] if version is None else version
    return df.where(F.col("version") == version).drop("version")


def month_spans(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The first and last day of each calendar month from first to last, for batches."""
    start = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    return spark.range(1).select(start.alias("first")).withColumn("last", F.least(F.last_day("first"), F.lit(last).cast("date")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
