"""The registered queries, on a raster made of the events table: 24 x 24 cells, 30 days from 2024-01-01."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.config import Axis, Settings
from eddyline.functions import scalars
from eddyline.operators import components, events, forest, frames, grid, overlay, tracking, windows
from eddyline.plans import analysis
from eddyline.sources import netcdf, raster, store, vector
from eddyline.sources.scratch import scratch_path, written
from eddyline.streaming import tracker

SIDE, DAYS = 24, 30
#: 2024-01-01 in days since 1970-01-01.
FIRST = 19_723
LAST = FIRST + DAYS - 1
#: Sizes that fit this raster: 5 cells a frame, 20 a volume, 4 days or more, windows of 13 days every 9.
SETTINGS = Settings(height=SIDE, width=SIDE, min_days=3, min_area_frame=500, min_area_time=2_000, window_days=12, step_days=9)
#: Where the raster lies: the first row's and column's degrees, and those from one to the next; metres of a projected cell.
LAT, LON, CELL = (-20.0, 2.5), (-30.0, 3.0), 400_000.0
AXES, CELLS = (Axis(*LAT, SIDE), Axis(*LON, SIDE)), Axis(0, 1, SIDE)
#: File names to be read, and a polygon.
NAMES = ("EV_000012_JAN_2018", "out/EV_2019_x-y_z.nc", "mhw_2018.nc", "mhw 1999.nc", "none", "a_77_b_2020_c_d")
RING = ((2.2, 1.3), (20.6, 4.1), (17.4, 21.7), (9.5, 12.4), (3.1, 19.8))
HOLE, PART = ((12.3, 6.2), (15.7, 7.1), (14.2, 9.6)), ((20.3, 19.2), (23.1, 19.7), (22.2, 22.8))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and cell, before smoothing."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_date(F.to_date("ts")).alias("t")
    y = ((F.col("user_id") * 7 + F.col("event_id")) % SIDE).cast("int").alias("yi")
    x = (F.expr("event_id div 7") % SIDE).cast("int").alias("xi")
    return df.groupBy(t, y, x).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"))


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.days(raster.smoothed(field(spark, sf_dir), SIDE, SIDE, 2), FIRST, LAST)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = written(smooth(spark, sf_dir), "raster")
    total = df.agg(F.sum("value")).head()[0] or 0  # one number
    return df.where(F.col("value") * (10 * DAYS * SIDE * SIDE) >= 11 * total).select("t", "yi", "xi")


def _labelled(spark, sf_dir):
    return analysis.labelled_frames(mask(spark, sf_dir), SETTINGS)


def _analysis(spark, sf_dir):
    return analysis.analyse(mask(spark, sf_dir), SETTINGS, LAST)


def raster_dense(spark, sf_dir):
    return raster.dense(smooth(spark, sf_dir), FIRST, LAST, SIDE, SIDE)


def slice_bbox_time(spark, sf_dir):
    return raster.box(raster.days(smooth(spark, sf_dir), FIRST + 5, FIRST + 12), 3, 15, 4, 20, "yi", "xi")


def stride_sample(spark, sf_dir):
    return raster.thinned(smooth(spark, sf_dir), 3)


def coarsen_block(spark, sf_dir):
    return raster.blocks(raster.dense(smooth(spark, sf_dir), FIRST, LAST, SIDE, SIDE), 5, SIDE, SIDE).select("t", "yi", "xi", "total", "n")


def upsample_repeat(spark, sf_dir):
    return raster.repeated(smooth(spark, sf_dir), 2)


def quantize_mask(spark, sf_dir):
    df = raster_dense(spark, sf_dir)
    return df.select("t", "yi", "xi", raster.over(F.col("value").cast("double"), 60_000.0).alias("bit"))


def frame_components(spark, sf_dir):
    return components.cells_of(components.label_frames(mask(spark, sf_dir), SIDE)).select("t", "yi", "xi", "component", "size")


def component_sizes(spark, sf_dir):
    return components.component_sizes(components.label_frames(mask(spark, sf_dir), SIDE))


def dust_frame(spark, sf_dir):
    return components.cells_of(_labelled(spark, sf_dir)).select("t", "yi", "xi", "component", "size")


def overlap_pairs(spark, sf_dir):
    return tracking.overlaps(_labelled(spark, sf_dir), SIDE)


def overlap_iou(spark, sf_dir):
    own = _labelled(spark, sf_dir)
    df = tracking.overlap_shares(tracking.overlaps(own, SIDE), components.component_sizes(own))
    return df.select("t", "prev", "cur", "inter", "in_union", (F.col("inter") * 5 > F.col("in_union")).alias("fits"))


def pair_diagnostics(spark, sf_dir):
    own = _analysis(spark, sf_dir).tracked
    return tracking.label_changes(components.component_sizes(own.withColumn("component", F.col("label"))).withColumnRenamed("component", "label"), tracking.overlaps(own, SIDE, "label"))


def cantor_roundtrip(spark, sf_dir):
    df = overlap_pairs(spark, sf_dir).select("prev", "cur").distinct().withColumn("code", scalars.pair_code(F.col("prev"), F.col("cur")))
    a, b = scalars.pair_of_code(F.col("code"))
    return df.withColumn("a", a).withColumn("b", b)


def _labels(runs: DataFrame) -> DataFrame:
    return runs.groupBy("t", "component", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("size"))


def track_labels(spark, sf_dir):
    return _labels(tracking.track(_labelled(spark, sf_dir), SIDE, SIDE * SIDE))


def track_labels_legacy(spark, sf_dir):
    return _labels(tracking.track(_labelled(spark, sf_dir), SIDE, SIDE * SIDE, None))


def dust_volume(spark, sf_dir):
    return components.cells_of(_analysis(spark, sf_dir).tracked).select("t", "yi", "xi", "label")


def components_3d(spark, sf_dir):
    return components.cells_of(components.components_3d(mask(spark, sf_dir), SIDE, SIDE * SIDE, SETTINGS.volume_cells)).select("t", "yi", "xi", "volume", "volume_size")


def renumber_labels(spark, sf_dir):
    return tracking.renumbered(_analysis(spark, sf_dir).tracked.select("t", "label").distinct())


def window_assign(spark, sf_dir):
    return windows.window_days(spark, FIRST, LAST, SETTINGS.window_days, SETTINGS.step_days)


def window_emit(spark, sf_dir):
    days = window_assign(spark, sf_dir)
    own = mask(spark, sf_dir).join(F.broadcast(days.select("t", "window_id")), "t")
    return windows.emitted(own, days).groupBy("window_id", "t").agg(F.count(F.lit(1)).alias("n"))


def _windowed(spark, sf_dir):
    return written(analysis.windowed_cells(mask(spark, sf_dir), SETTINGS, FIRST, LAST), "windows")


def window_tracks(spark, sf_dir):
    return _windowed(spark, sf_dir).groupBy("window_id", "t", "label").agg(F.count(F.lit(1)).alias("n"))


def label_pairs(spark, sf_dir):
    return windows.label_pairs(_windowed(spark, sf_dir), window_assign(spark, sf_dir))


def label_map(spark, sf_dir):
    return windows.label_map(label_pairs(spark, sf_dir))


def full_label_map(spark, sf_dir):
    cells = _windowed(spark, sf_dir)
    return windows.full_map(windows.label_map(windows.label_pairs(cells, window_assign(spark, sf_dir)).where("a <> b")), cells)


def relabel_overlap(spark, sf_dir):
    cells = _windowed(spark, sf_dir)
    return windows.stitched(cells, windows.label_map(windows.label_pairs(cells, window_assign(spark, sf_dir))))


def labels_as_written(spark, sf_dir):
    """Windows by the label groups known when each was written."""
    return analysis.windowed_labels(mask(spark, sf_dir), SETTINGS, FIRST, LAST, retroactive=False)


def incremental_map(spark, sf_dir):
    """The map of all labels after the windows' pairs came in one batch a window."""
    cells, path = _windowed(spark, sf_dir), scratch_path(spark, "forest")
    pairs = written(windows.pairs_by_window(cells, window_assign(spark, sf_dir)), "pairs")
    for k in (0, 1):
        forest.add(pairs.where(F.col("window_id") == k), path, k)
    return forest.mapping(cells, path)


def lifetimes(spark, sf_dir):
    return events.lifetimes(_analysis(spark, sf_dir).tracked.select("label", "t").distinct(), LAST).select("label", "seq", "first", "end")


def lifetime_intervals(spark, sf_dir):
    return _analysis(spark, sf_dir).spans


def _dated(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, which every engine prints alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def events_table(spark, sf_dir):
    return _dated(_analysis(spark, sf_dir).found, "start", "end")


def events_windowed(spark, sf_dir):
    return _dated(analysis.windowed_events(mask(spark, sf_dir), SETTINGS, FIRST, LAST), "start", "end")


def _event_cells(spark, sf_dir):
    own = _analysis(spark, sf_dir)
    return events.event_cells(components.cells_of(own.tracked), own.found)


def event_cells(spark, sf_dir):
    return _event_cells(spark, sf_dir)


def closing_days(spark, sf_dir):
    return events.cut_by_overlap(pair_diagnostics(spark, sf_dir))


def fill_small_holes(spark, sf_dir):
    cells = components.cells_of(_labelled(spark, sf_dir)).select("t", "yi", "xi", F.col("component").alias("label"))
    return components.fill_holes(cells, SIDE, SIDE, SETTINGS.hole_max)


def period_overlay(spark, sf_dir):
    return overlay.period_overlay(_event_cells(spark, sf_dir), FIRST + 8, FIRST + 20, SIDE, SIDE)


def _land(spark):
    flag = F.when((F.col("yi") + F.col("xi")) % 7 == 0, 2).otherwise(1)
    return raster.spine(spark, 0, 0, SIDE, SIDE).select("yi", "xi", flag.alias("mask"))


def mask_join(spark, sf_dir):
    return overlay.masked(smooth(spark, sf_dir).select("t", "yi", "xi", "value"), _land(spark))


def event_values(spark, sf_dir):
    return overlay.aligned(_event_cells(spark, sf_dir), mask_join(spark, sf_dir)).groupBy("id").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


def polygon_mask(spark, sf_dir):
    rings = spark.createDataFrame([("A", [{"x": x, "y": y} for x, y in RING])], "region string, ring array<struct<x:double,y:double>>")
    return overlay.polygon_cells(rings, CELLS, CELLS)


def centroids(spark, sf_dir):
    return overlay.centroids(_event_cells(spark, sf_dir), "id", "t")


def label_places(spark, sf_dir):
    return overlay.label_places(_event_cells(spark, sf_dir), SIDE, SIDE, "id", "t")


def value_range(spark, sf_dir):
    df = overlay.value_range(raster_dense(spark, sf_dir))
    return df.select(*[F.round(c, 3).alias(c) for c in ("mean", "spread", "low", "high")], "least", "largest")


def frame_norm(spark, sf_dir):
    return overlay.frame_levels(smooth(spark, sf_dir)).select("t", "yi", "xi", "level")


def file_name_parts(spark, sf_dir):
    name = F.col("name")
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return df.select("name", scalars.year_in_name(name).alias("year"), scalars.serial_in_name(name).alias("serial"), scalars.year_in_file_name(name).alias("file_year"), scalars.base_name(name).alias("base"))


def month_batches(spark, sf_dir):
    return _dated(store.month_spans(spark, "2024-01-01", "2024-12-15"), "first", "last")


def _places(spark):
    return raster.spine(spark, 0, 0, SIDE, SIDE).select("yi", "xi", (F.col("yi") * LAT[1] + LAT[0]).alias("lat"), (F.col("xi") * LON[1] + LON[0]).alias("lon"))


def sinusoidal_xy(spark, sf_dir):
    x, y = grid.sinusoidal(F.col("lat"), F.col("lon"), ellipsoid=False)
    return _places(spark).select("yi", "xi", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def reproject_bilinear(spark, sf_dir):
    unit, half = Axis(0, 1, SIDE), Axis(0, 0.5, 2 * SIDE)
    df = frames.resampled(raster_dense(spark, sf_dir), frames.Bilinear(unit, unit, half, half))
    return df.select("t", "yi", "xi", F.round("value", 3).alias("value"))


def labels_nearest(spark, sf_dir):
    coarse = raster.spine(spark, 0, 0, 10, 10).select("yi", "xi", (F.col("yi") * 2.3).alias("lat"), (F.col("xi") * 2.3).alias("lon"))
    cells = components.cells_of(_labelled(spark, sf_dir)).select("t", "yi", "xi", F.col("component").alias("label"))
    return grid.carried(cells, grid.nearest_cells(coarse, 0, 1, 0, 1, SIDE, SIDE))


def vector_mask(spark, sf_dir):
    """The polygon with a hole in it, and a second part of its region, read from a vector file; with the cells that edges touch."""
    path = scratch_path(spark, "vector")
    shape = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"code": "A"}, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in RING], [list(p) for p in HOLE]]}},
        {"type": "Feature", "properties": {"code": "A"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[list(p) for p in PART]]]}},
    ]}
    spark.createDataFrame([(json.dumps(shape),)], "value string").coalesce(1).write.text(path)
    rings = vector.rings(spark, path, "code")
    inside, touched = overlay.polygon_cells(rings, CELLS, CELLS), overlay.touched_cells(rings, 0, 1, 0, 1, SIDE, SIDE)
    return inside.withColumn("inside", F.lit(1)).join(touched.withColumn("touched", F.lit(1)), ["region", "yi", "xi"], "full").fillna(0, ["inside", "touched"])


def stream_tracks(spark, sf_dir):
    """The tracker on a stream of frames, which gives the labels of the batch."""
    path, own = scratch_path(spark, "stream"), written(mask(spark, sf_dir), "mask")
    own.select(F.lit("r").alias("region"), "t", "yi", "xi").coalesce(1).write.parquet(f"{path}/in")
    frames = spark.readStream.schema("region string, t int, yi int, xi int").parquet(f"{path}/in")
    runs = tracker.track_stream(frames, SIDE, SIDE, SETTINGS.frame_cells)
    runs.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return _labels(spark.read.parquet(f"{path}/out"))


def _located(df: DataFrame) -> DataFrame:
    return df.withColumn("lat", F.col("yi") * LAT[1] + LAT[0]).withColumn("lon", F.col("xi") * LON[1] + LON[0])


def box_text(spark, sf_dir):
    own = _located(_event_cells(spark, sf_dir)).groupBy("id").agg(*(f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "least"), (F.max, "most"))))
    return own.select("id", scalars.box_text(F.col("lat_least"), F.col("lat_most"), F.col("lon_least"), F.col("lon_most")).alias("box"))


def input_path(spark, sf_dir):
    """A yearly raster with other names for its axes and a column too many, from storage to the working table."""
    own = _located(smooth(spark, sf_dir)).select(F.date_from_unix_date("t").alias("time"), "yi", "xi", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("value").cast("double").alias("intensity"), F.lit("strong").alias("category"))
    older = own.withColumns({"time": F.date_sub("time", 365), "intensity": F.lit(1.0)})
    path = scratch_path(spark, "yearly")
    own.unionAll(older).withColumn("year", F.year("time")).write.partitionBy("year").parquet(path)
    return raster.load(spark, path, "intensity", FIRST + 5, FIRST + 20, (-11.0, 20.0, -20.0, 31.0), 2, AXES).select("t", "yi", "xi", "lat", "lon", "value")


def _province(spark):
    return polygon_mask(spark, "")


def preprocess_province(spark, sf_dir):
    return raster.preprocessed(smooth(spark, sf_dir).withColumn("category", F.lit(1)), 60_000.0, _province(spark))


def _projected(spark, sf_dir, triangles: bool = False):
    return frames.projected(raster_dense(spark, sf_dir), *AXES, CELL, triangles=triangles)


def project_raster(spark, sf_dir):
    return _projected(spark, sf_dir)[0].select("t", "yi", "xi", F.round("value", 0).alias("value"))


def project_triangles(spark, sf_dir):
    return _projected(spark, sf_dir, True)[0].select("t", "yi", "xi", F.round("value", 0).alias("value"))


def project_back(spark, sf_dir):
    df, ys, xs = _projected(spark, sf_dir)
    return frames.back(df, ys, xs, *AXES).select("t", "yi", "xi", F.round("value", 0).alias("value"))


def labels_back(spark, sf_dir):
    df, ys, xs = _projected(spark, sf_dir)
    labels = df.where("value >= 60000").select("t", "yi", "xi", (F.col("yi") * 1000 + F.col("xi")).cast("long").alias("label"))
    return grid.labels_back(labels, _places(spark), ys.start, xs.start, CELL, ys.size, xs.size)


def saved_windows(spark, sf_dir):
    path = scratch_path(spark, "saved")
    store.save_windows(_windowed(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("window_id", "t").agg(F.count(F.lit(1)).alias("n"))


def named_tables(spark, sf_dir):
    path, own = scratch_path(spark, "named"), written(mask(spark, sf_dir), "mask")
    for name, first, last in (("mask_0_to_9", 0, 9), ("mask_10_to_19", 10, 19), ("rest", 20, 29)):
        raster.days(own, FIRST + first, FIRST + last).write.parquet(f"{path}/{name}")
    return store.named(spark, path, "*_to_*").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def saved_events(spark, sf_dir):
    own, path = _analysis(spark, sf_dir), scratch_path(spark, "events")
    analysis.store_events(own.found, events.event_cells(components.cells_of(own.tracked), own.found), SETTINGS, path)
    return spark.read.parquet(f"{path}/event_cells").select("id", "year", "t", "yi", "xi")


def netcdf_scan(spark, sf_dir):
    """The raster as files of ten days each, of which the wanted days and rows are read."""
    path, own = scratch_path(spark, "netcdf"), smooth(spark, sf_dir)
    netcdf.save(own.withColumn("file", F.concat(F.lit("days_"), F.expr(f"(t - {FIRST}) div 10"))), path, *AXES, "intensity", "double")
    df = netcdf.scan(spark, f"{path}/days_*.nc", "intensity", FIRST + 4, FIRST + 23)
    return df.where(F.col("lat").between(-11.0, 20.0) & (F.col("lon") > -18.0)).select("file", "t", "yi", "xi", "lat", "lon", "value")


def netcdf_events(spark, sf_dir):
    """Events as files on a finer grid, one an event, read back."""
    own, path = _analysis(spark, sf_dir), scratch_path(spark, "events")
    lat, lon = Axis(LAT[0], 2.0, 30), Axis(LON[0], 2.4, 30)
    fine = raster.spine(spark, 0, 0, 30, 30).select("yi", "xi", (F.col("yi") * 0.8).alias("lat"), (F.col("xi") * 0.8).alias("lon"))
    back = lambda labels: grid.carried(labels, grid.nearest_cells(fine, 0, 1, 0, 1, SIDE, SIDE))
    analysis.store_event_files(own.found, events.event_cells(components.cells_of(own.tracked), own.found), SETTINGS, path, lat, lon, back)
    if not own.found.head(1):
        return spark.createDataFrame([], netcdf.SCHEMA).where("value = 1").drop("value")
    return netcdf.scan(spark, path, "event").where("value = 1").drop("value")


def newest_year(spark, sf_dir):
    return store.newest_year(smooth(spark, sf_dir).withColumn("year", F.expr(f"2000 + (t - {FIRST}) div 7"))).select("year", "t", "yi", "xi", "value")


def appended_days(spark, sf_dir):
    path, own = scratch_path(spark, "days"), written(raster_dense(spark, sf_dir), "dense")
    for first, last in ((0, 9), (10, 19), (20, 29)):
        store.append(raster.days(own, FIRST + first, FIRST + last), path)
    return spark.read.parquet(path).groupBy("t").agg(F.sum("value").alias("total"))


def joined_stretches(spark, sf_dir):
    """Two stretches of days over the same axes as one raster."""
    own = written(raster_dense(spark, sf_dir), "dense")
    both = store.joined(raster.days(own, FIRST, FIRST + 11), raster.days(own, FIRST + 12, LAST))
    return both.groupBy("yi", "xi").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def shared_spans(spark, sf_dir):
    """The days that each event shares with the next one by number, where these are more than one."""
    own = _analysis(spark, sf_dir).found.select("id", "serial", "start_t", "end_t")
    after = own.select(F.col("id").alias("next_id"), (F.col("serial") - 1).alias("serial"), F.col("start_t").alias("b"), F.col("end_t").alias("e"))
    both = own.join(after, "serial").select("id", "next_id", scalars.shared_days(F.col("start_t"), F.col("end_t"), F.col("b"), F.col("e")).alias("s"))
    return both.where("s is not null").select("id", "next_id", "s.first", "s.last")


def extended_batches(spark, sf_dir):
    """Two runs, the second of which goes on from what the first has stored."""
    own, path = written(mask(spark, sf_dir), "mask"), scratch_path(spark, "state")
    analysis.extended(raster.days(own, FIRST, FIRST + 17), SETTINGS, FIRST, FIRST + 17, path).count()
    return analysis.extended(own, SETTINGS, FIRST, LAST, path)


def nearest_rows(spark, sf_dir):
    return grid.nearest_value(_located(smooth(spark, sf_dir)).select("t", "yi", "xi", "lat", "value"), "lat", 7.1)


def affine_corners(spark, sf_dir):
    return spark.createDataFrame([grid.affine(LON[0], LON[1], LAT[0], LAT[1])], "a double, b double, c double, d double, e double, f double")


def all_codes(spark, sf_dir):
    return tracking.all_codes(_labelled(spark, sf_dir))


def dissolved_regions(spark, sf_dir):
    own = raster.spine(spark, 0, 0, SIDE, SIDE).select("yi", "xi")
    rows, columns = own.withColumn("region", F.concat(F.lit("R"), F.expr("yi div 6"))), own.withColumn("region", F.concat(F.lit("C"), F.expr("xi div 6")))
    region = overlay.dissolved(rows.unionAll(columns), ["R0", "C2"])
    return overlay.in_region(mask(spark, sf_dir), region)


def last_label(spark, sf_dir):
    return spark.createDataFrame([(windows.last_label(_analysis(spark, sf_dir).tracked),)], "label long")


QUERIES = {
    f.__name__: f
    for f in (
        events_table, raster_dense, slice_bbox_time, stride_sample, coarsen_block, upsample_repeat, quantize_mask, frame_components, component_sizes, dust_frame,
        overlap_pairs, overlap_iou, pair_diagnostics, cantor_roundtrip, track_labels, track_labels_legacy, dust_volume, components_3d, renumber_labels, window_assign,
        window_emit, window_tracks, label_pairs, label_map, full_label_map, relabel_overlap, labels_as_written, incremental_map, lifetimes, lifetime_intervals, events_windowed, event_cells, closing_days,
        fill_small_holes, period_overlay, mask_join, event_values, polygon_mask, centroids, value_range, frame_norm, file_name_parts, month_batches, sinusoidal_xy,
        reproject_bilinear, labels_nearest, stream_tracks, vector_mask, label_places, box_text, input_path, preprocess_province, project_raster, project_triangles, project_back, labels_back, saved_windows, named_tables,
        saved_events, netcdf_scan, netcdf_events, newest_year, appended_days, joined_stretches, shared_spans, extended_batches, nearest_rows, affine_corners, all_codes, dissolved_regions, last_label,
    )
}
