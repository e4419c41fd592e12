"""Overlapping windows of days, and one label space out of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.config import window_starts
from eddyline.sources.scratch import written

from . import forest
from .graph import connected_components
from .tracking import SPACE


def window_days(spark: SparkSession, first: int, last: int, window: int, step: int) -> DataFrame:
    """(window_id, t, first, last, emit_last, is_last): each window's days; those up to emit_last are its own, the rest it shares with the next."""
    spans = window_starts(first, last, window, step)
    rows = [(k, a, b, b if final else spans[k + 1][0] - 1, final) for k, (a, b, final) in enumerate(spans)]
    df = spark.createDataFrame(rows, "window_id int, first int, last int, emit_last int, is_last boolean")
    return df.withColumn("t", F.explode(F.sequence("first", "last")))


def emitted(windowed: DataFrame, windows: DataFrame) -> DataFrame:
    """Of windowed rows (window_id, t) those that a window itself gives out."""
    own = F.broadcast(windows.where("t <= emit_last").select("window_id", "t"))
    return windowed.join(own, ["window_id", "t"], "left_semi")


def label_pairs(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (a, b) over all ``pairs_by_window``."""
    return pairs_by_window(cells, windows).select("a", "b").distinct()


def pairs_by_window(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (window_id, a, b) of a window's labels and the next one's on the days that both cover; a label that meets none is paired with itself.

    cells: window_id, t, yi, xi, label; windows: window_id, first and last day. A window covers its days whether labels lie on them or not.
    """
    spans = windows.select("window_id", "first", "last").distinct()  # one row a window
    after = spans.select((F.col("window_id") - 1).alias("window_id"), F.col("first").alias("from_t"))
    before = spans.select((F.col("window_id") + 1).alias("window_id"), F.col("last").alias("to_t"))
    one = cells.join(F.broadcast(after), "window_id").where("t >= from_t").select("window_id", "t", "yi", "xi", F.col("label").alias("a"))
    two = cells.join(F.broadcast(before), "window_id").where("t <= to_t").select((F.col("window_id") - 1).alias("window_id"), "t", "yi", "xi", F.col("label").alias("b"))
    both = one.join(two, ["window_id", "t", "yi", "xi"], "full")
    return both.select("window_id", F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).distinct()


def label_map(pairs: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """(child, mother): every label of the pairs with the smallest of its group. A persisted map takes part as further pairs."""
    if persisted is not None:
        pairs = pairs.select("a", "b").unionAll(persisted.select(F.col("child"), F.col("mother")).toDF("a", "b"))
    nodes = pairs.select(F.col("a").alias("child")).unionAll(pairs.select("b")).distinct()
    roots = connected_components(pairs).withColumnRenamed("node", "child")
    return nodes.join(roots, "child", "left").select("child", F.coalesce("root", "child").alias("mother"))


def full_map(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """A map over all labels that occur (``label``); those without a mother are their own."""
    every = labels.select(F.col("label").alias("child")).distinct()
    return every.join(mapping, "child", "left").select("child", F.coalesce("mother", "child").alias("mother"))


def relabelled(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels replaced by their mothers."""
    own = mapping.select(F.col("child").alias("label"), "mother")
    return df.join(own, "label", "left").withColumn("label", F.coalesce("mother", "label")).drop("mother")


def stitched(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """One raster of labels (t, yi, xi, label): a cell labelled in any of its windows has their mother label, the smallest where they differ."""
    return relabelled(cells, mapping).groupBy("t", "yi", "xi").agg(F.min("label").alias("label"))


def as_written(cells: DataFrame, windows: DataFrame, path: str) -> DataFrame:
    """(t, yi, xi, label) as windows gave their own days out, one after the other: by the groups that were known when a window was written, so later merges don't show.

    windows: see ``window_days``. A window is written when its overlap with the one before is reconciled. The forest below
    ``path`` grows by one batch a window; windows whose batch is stored aren't looked at again.
    """
    pairs = written(pairs_by_window(cells, windows), "pairs")
    ids = [r[0] for r in windows.select("window_id").distinct().orderBy("window_id").collect()]  # one row a window
    for k in ids[1:]:
        forest.add(pairs.where(F.col("window_id") == k - 1), path, k)
    days = F.broadcast(windows.where("t <= emit_last").select("t", F.col("window_id").alias("writer")))  # one row a day
    shown = written(cells.join(days, "t").where("window_id <= writer").select("t", "yi", "xi", "label", "writer"), "shown")
    told = forest.representatives(shown, forest.rows(cells.sparkSession, path), "label", "writer")
    return told.groupBy("t", "yi", "xi").agg(F.min("root").alias("label"))


def last_label(df: DataFrame, label: str = "label") -> int:
    """The counter that goes on after these labels: their largest; 1 for none."""
    found = df.agg(F.max(label)).head()[0]
    return 1 if found is None else int(found)


def resume_day(overlap_last: int, window: int, step: int) -> int:
    """Where a run begins again whose stored overlap ends on a day."""
    return overlap_last - (window - step)

