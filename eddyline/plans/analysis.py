"""Whole analyses: from a mask of cells to events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.config import Axis, Settings
from eddyline.operators import components, events, tracking, windows
from eddyline.plans.timing import Steps
from eddyline.sources import netcdf, store
from eddyline.sources.scratch import scratch_path, written


@dataclass
class Analysis:
    """labelled and tracked are runs; cells are (t, yi, xi, label); found has one row an event."""

    labelled: DataFrame
    tracked: DataFrame
    spans: DataFrame
    found: DataFrame


def labelled_frames(mask: DataFrame, s: Settings) -> DataFrame:
    """Labelled runs without dust, written once: tracking reads them three times."""
    own = components.label_frames(mask, s.width, s.frame_connectivity, s.dust_connectivity)
    return written(components.dust_frames(own, s.frame_cells), "labelled")


def tracked_runs(labelled: DataFrame, s: Settings, days: DataFrame | None = None) -> DataFrame:
    """Tracked runs, in one window or in those of ``days``, without volumes that are too small."""
    own = written(tracking.track(labelled, s.width, s.cells, s.iou, days), "tracked")
    return components.dust_volume(own, s.volume_cells, s.cells, s.width)


def counted(runs: DataFrame) -> DataFrame:
    return runs.select("t", "label", (F.col("x1") - F.col("x0") + 1).alias("n"))


def events_of(tracked: DataFrame, s: Settings, last_day: int) -> tuple[DataFrame, DataFrame]:
    """(intervals, events) of tracked runs."""
    spans = events.intervals(events.lifetimes(tracked.select("label", "t").distinct(), last_day, s.close_open_events), s.gap_start)
    return spans, events.events(counted(tracked), spans, s.min_days, s.event_cells, s.cell_area)


def analyse(mask: DataFrame, s: Settings, last_day: int, steps: Steps | None = None) -> Analysis:
    """Everything in one window; ``steps`` gets what labelling and tracking cost."""
    steps = steps or Steps()
    with steps("label"):
        labelled = labelled_frames(mask, s)
    with steps("track"):
        tracked = written(tracked_runs(labelled, s), "volumes")
    with steps("events"):
        spans, found = events_of(tracked, s, last_day)
    return Analysis(labelled, tracked, spans, found)


def windowed_cells(mask: DataFrame, s: Settings, first_day: int, last_day: int) -> DataFrame:
    """(window_id, t, yi, xi, label) of every window, each tracked for itself."""
    days = windows.window_days(mask.sparkSession, first_day, last_day, s.window_days, s.step_days).select("window_id", "t")
    return components.cells_of(tracked_runs(labelled_frames(mask, s), s, days)).select("window_id", "t", "yi", "xi", "label")


def windowed_labels(mask: DataFrame, s: Settings, first_day: int, last_day: int, retroactive: bool = True) -> DataFrame:
    """(t, yi, xi, label) after the windows' labels are reconciled; with ``retroactive=False`` each window's days by what was known when it was written."""
    cells = written(windowed_cells(mask, s, first_day, last_day), "windows")
    days = windows.window_days(mask.sparkSession, first_day, last_day, s.window_days, s.step_days)
    if not retroactive:
        return windows.as_written(cells, days, scratch_path(mask.sparkSession, "forest"))
    return windows.stitched(cells, windows.label_map(windows.label_pairs(cells, days)))


def extended(mask: DataFrame, s: Settings, first_day: int, last_day: int, path: str) -> DataFrame:
    """(t, yi, xi, label) of all days so far, in batches: windows that an earlier run has stored whole under ``path`` aren't computed again.

    A run begins at the first window that isn't whole, ``resume_day`` of the stored overlap; its pairs with the
    window before it, and the stored map, give the labels of all. Runs one after the other agree with one over all days.
    """
    spark = mask.sparkSession
    days = windows.window_days(spark, first_day, last_day, s.window_days, s.step_days)
    state = store.load_state(spark, f"{path}/state") if store._exists(spark, f"{path}/state") else None
    whole, overlap_last = state.select("whole", "overlap_last").head() if state is not None else (-1, None)
    start = first_day if overlap_last is None else windows.resume_day(overlap_last, s.window_days, s.step_days)
    todo = days.where(F.col("window_id") > whole)
    cells = components.cells_of(tracked_runs(labelled_frames(mask.where(F.col("t").between(start, last_day)), s), s, todo.select("window_id", "t")))
    store.save_windows(cells.select("window_id", "t", "yi", "xi", "label"), f"{path}/windows")
    stored = spark.read.parquet(f"{path}/windows")
    pairs = windows.label_pairs(stored.where(F.col("window_id") >= whole), days)
    known = store.load_state(spark, f"{path}/map") if state is not None else None
    mapping = written(windows.label_map(pairs, known), "map")
    # Of windows that will be computed again nothing is remembered.
    full = [r[0] for r in days.where(F.col("last") - F.col("first") == s.window_days).select("window_id").distinct().collect()]  # one row a window
    done = max(full, default=-1)
    version = 0 if state is None else int(state.select("run").head()[0]) + 1
    lasting = stored.where(F.col("window_id") <= done).select(F.col("label").alias("child")).distinct()
    store.save_state(mapping.join(lasting, "child", "left_semi").join(lasting.select(F.col("child").alias("mother")), "mother", "left_semi").select("child", "mother"), f"{path}/map", version)
    store.save_state(spark.createDataFrame([(version, done, first_day + (done + 1) * s.step_days + s.window_days - s.step_days if done >= 0 else None)], "run int, whole int, overlap_last int"), f"{path}/state", version)
    return windows.stitched(stored, mapping)


def event_shapes(found: DataFrame, cells: DataFrame, s: Settings, back: Callable[[DataFrame], DataFrame] | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """(id, t, yi, xi) of events from their cells (t, yi, xi, serial), after ``back`` has carried them to another grid, of ``size`` (height, width), and small holes are filled there."""
    labels = cells.select("t", "yi", "xi", F.col("serial").cast("long").alias("label"))
    filled = components.fill_holes(back(labels) if back else labels, *(size or (s.height, s.width)), s.hole_max)
    return filled.join(found.select("id", F.col("serial").cast("long").alias("label")), "label").drop("label")


def store_events(found: DataFrame, cells: DataFrame, s: Settings, path: str, back: Callable[[DataFrame], DataFrame] | None = None, size: tuple[int, int] | None = None) -> None:
    """Store events and their ``event_shapes`` as tables."""
    store.save_events(found, event_shapes(found, cells, s, back, size), path)


def store_event_files(found: DataFrame, cells: DataFrame, s: Settings, path: str, lat: Axis, lon: Axis, back: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Store events as NetCDF files, one an event, named by its id: a byte of 1 for each cell that it covers on a day, on latitude and longitude; identifier, size and cell area as attributes of the file."""
    told = F.to_json(F.struct(F.col("id").alias("ID"), "pixel_sum", F.lit(s.cell_area).alias("pixel_area_km")))
    shapes = event_shapes(found, cells, s, back, (lat.size, lon.size)).join(found.select("id", told.alias("attributes")), "id")
    netcdf.save(shapes.select(F.col("id").alias("file"), "t", "yi", "xi", F.lit(1.0).alias("value"), "attributes"), path, lat, lon, "event", "byte", 0)


def windowed_events(mask: DataFrame, s: Settings, first_day: int, last_day: int) -> DataFrame:
    """Events from overlapping windows: memory is bounded by a window, whatever the number of days."""
    cells = written(windowed_labels(mask, s, first_day, last_day), "stitched")
    return events_of(components.runs(cells, "label"), s, last_day)[1]
