"""Events: how long labels live, which of them count, what they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eddyline.functions.scalars import event_name

from .tracking import numbered


def lifetimes(days: DataFrame, last_day: int, close_open: bool = True) -> DataFrame:
    """(label, seq, first, island_first, end) from distinct (label, t): each stretch of days without a gap.

    first is the label's first day. Without ``close_open`` what is alive on the last day has no end and is left out.
    """
    own = Window.partitionBy("label").orderBy("t")
    island = days.select("label", "t").withColumn("island", F.col("t") - F.row_number().over(own))
    spans = island.groupBy("label", "island").agg(F.min("t").alias("island_first"), F.max("t").alias("end"))
    order = Window.partitionBy("label").orderBy("end")
    out = spans.withColumn("first", F.min("island_first").over(Window.partitionBy("label"))).withColumn("seq", F.row_number().over(order)).withColumn("before", F.lag("end").over(order))
    out = out.select("label", "seq", "first", "island_first", "end", "before")
    return out if close_open else out.where(F.col("end") != last_day)


def intervals(spans: DataFrame, gap_start: str = "reference") -> DataFrame:
    """(label, seq, first_day, start, end): after a gap an interval starts the day after the one before ended, or on reappearance ("island")."""
    start = F.col("island_first") if gap_start == "island" else F.coalesce(F.col("before") + 1, F.col("first"))
    return spans.select("label", "seq", F.col("first").alias("first_day"), start.cast("int").alias("start"), "end")


def events(cells: DataFrame, spans: DataFrame, min_days: int, min_cells: int, cell_area: int) -> DataFrame:
    """id, label, start, end (dates), pixel_sum, area_km2 of the intervals that last and cover enough. Runs or cells: t, label, n (cells)."""
    long = spans.where(F.col("end") - F.col("start") >= min_days)
    per_day = cells.groupBy("label", "t").agg(F.sum("n").alias("n"))
    inside = long.join(per_day, "label").where("t between start and end")
    sums = inside.groupBy("label", "seq", "first_day", "start", "end").agg(F.sum("n").cast("long").alias("pixel_sum")).where(F.col("pixel_sum") >= min_cells)
    start = F.date_from_unix_date("start")
    return numbered(sums, "first_day", "label", "end", name="serial").select(
        event_name(F.col("serial"), start).alias("id"), "serial", "label", F.col("start").alias("start_t"), F.col("end").alias("end_t"), start.alias("start"), F.date_from_unix_date("end").alias("end"), "pixel_sum", (F.col("pixel_sum") * cell_area).alias("area_km2")
    )


def event_cells(cells: DataFrame, found: DataFrame) -> DataFrame:
    """(id, serial, t, yi, xi) of each event."""
    own = found.select("id", "serial", "label", "start_t", "end_t")
    return cells.join(own, "label").where("t between start_t and end_t").select("id", "serial", "t", "yi", "xi")


def cut_by_overlap(changes: DataFrame, least: tuple[int, int] = (1, 2)) -> DataFrame:
    """Days on which a label would be closed because it keeps too little of itself: label, t. changes: see ``label_changes``."""
    num, den = least
    return changes.where((F.col("next_size") > 0) & (F.col("inter") * den < F.col("in_union") * num)).select("label", "t")
