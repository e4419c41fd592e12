"""Hand-drawn rasters with known results, a flood fill, and the queries against their SQL."""

import duckdb
import numpy as np
import pytest

from eddyline.config import Settings, cells_of_area, check_box, overlap_of_days, window_starts, windows_shown
from eddyline.functions import scalars
from eddyline.operators import components, events, graph, grid, overlay, tracking, windows
from eddyline.plans import oracles, queries
from eddyline.sources import raster, store
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def cells(spark, rows):
    return spark.createDataFrame(rows, "t int, yi int, xi int")


def row0(spark, *days):
    """Stretches of row 0 by day: [(first, last), ...]."""
    return cells(spark, [(t, 0, x) for t, spans in enumerate(days) for a, b in spans for x in range(a, b + 1)])


def tracked(spark, mask, width=20, **kw):
    own = tracking.track(components.label_frames(mask, width), width, width, **kw)
    return {(r.t, r.x0): r.label for r in own.collect()}


def test_settings():
    s = Settings(height=10, width=10)
    assert (s.frame_cells, s.volume_cells, s.event_cells) == (1000, 5000, 5000)
    assert Settings(height=1, width=1, min_area_time=100).volume_cells == 5
    assert cells_of_area(101, 10) == 2
    assert windows_shown(365, 200, 150) == 2 and windows_shown(10, 20, 5) == 0
    with pytest.raises(ValueError):
        windows_shown(10, 5, 0)
    with pytest.raises(ValueError):
        check_box([10, 80, 90, -70])
    assert overlap_of_days((0, 5), (5, 9)) is None and overlap_of_days((0, 6), (5, 9)) == (5, 6)
    assert window_starts(0, 29, 12, 9) == [(0, 12, False), (9, 21, False), (18, 29, True)]


def test_diagonal_and_dust(spark):
    own = components.label_frames(cells(spark, [(0, 0, 0), (0, 1, 1)]), 5)
    assert {r["size"] for r in own.collect()} == {2} and {r.piece_size for r in own.collect()} == {1}
    assert components.dust_frames(own, 2).count() == 0


def test_holes(spark):
    ring = [(0, y, x) for y in range(1, 4) for x in range(1, 4) if (y, x) != (2, 2)]
    out = components.fill_holes(cells(spark, ring).withColumn("label", F.lit(7)), 5, 5, 10)
    assert {(r.yi, r.xi) for r in out.collect()} == {(y, x) for _, y, x in ring} | {(2, 2)}
    corner = components.fill_holes(cells(spark, [(0, 0, 1), (0, 1, 0)]).withColumn("label", F.lit(7)), 4, 4, 10)
    assert (0, 0) in {(r.yi, r.xi) for r in corner.collect()} and corner.count() == 3


def test_matching(spark):
    assert len(set(tracked(spark, row0(spark, [(0, 2)], [(2, 4)])).values())) == 2  # exactly 0.2
    assert len(set(tracked(spark, row0(spark, [(0, 2)], [(1, 3)])).values())) == 1
    split = tracked(spark, row0(spark, [(0, 6)], [(0, 2), (4, 6)], [(0, 0), (4, 6)]))
    assert split[0, 0] == split[1, 0] == split[1, 4] == split[2, 4] != split[2, 0]
    tie = tracked(spark, row0(spark, [(0, 1), (3, 4)], [(0, 4)]))
    assert tie[1, 0] == tie[0, 0]
    rank = tracked(spark, row0(spark, [(0, 9), (11, 13)], [(6, 13)]))
    assert rank[1, 6] == rank[0, 0]
    gap = tracked(spark, row0(spark, [(0, 4)], [], [(0, 4)]))
    assert gap[0, 0] != gap[2, 0]


def test_window_of_its_own_forgets_a_split(spark):
    mask = row0(spark, [(0, 6)], [(0, 2), (4, 6)], [(0, 0), (4, 6)])
    days = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2)], "window_id int, t int")
    own = tracking.track(components.label_frames(mask, 20), 20, 20, windows=days).where("window_id = 1")
    got = {(r.t, r.x0): r.label for r in own.collect()}
    assert got[2, 0] == got[1, 0] != got[1, 4]


def test_lifetimes(spark):
    days = spark.createDataFrame([(1, t) for t in [*range(7), *range(9, 16)]], "label int, t int")
    spans = events.lifetimes(days, 16)
    for how, second in (("reference", (7, 15)), ("island", (9, 15))):
        assert [(r.start, r.end) for r in events.intervals(spans, how).orderBy("seq").collect()] == [(0, 6), second]
    alive = spark.createDataFrame([(1, t) for t in range(10)], "label int, t int")
    assert events.lifetimes(alive, 9).count() == 1 and events.lifetimes(alive, 9, False).count() == 0


def test_label_map(spark):
    pairs = spark.createDataFrame([(3, 10), (4, 10), (11, 11), (5, 5)], "a long, b long")
    got = {r.child: r.mother for r in windows.label_map(pairs).collect()}
    assert got == {3: 3, 4: 3, 10: 3, 11: 11, 5: 5}


def test_components_long_path_and_hub(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    roots = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(path, "a long, b long").repartition(8)).collect()}
    assert all(roots[i] == 0 for i in range(201)) and all(roots[1000 + k] == 1000 for k in range(300))
    rounds = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(path, "a long, b long").repartition(8), small=-1).collect()}
    assert rounds == roots


def test_flood_fill(spark):
    rng = np.random.default_rng(3)
    grid_ = rng.random((30, 30)) < 0.5
    got = {(r.yi, r.xi): r.component for r in components.cells_of(components.label_frames(cells(spark, [(0, int(y), int(x)) for y, x in zip(*np.nonzero(grid_), strict=True)]), 30)).collect()}
    seen = {}
    for y, x in zip(*np.nonzero(grid_), strict=True):
        if (y, x) in seen:
            continue
        todo = [(y, x)]
        seen[y, x] = y * 30 + x
        while todo:
            a, b = todo.pop()
            for p in range(max(0, a - 1), min(30, a + 2)):
                for q in range(max(0, b - 1), min(30, b + 2)):
                    if grid_[p, q] and (p, q) not in seen:
                        seen[p, q] = y * 30 + x
                        todo.append((p, q))
    assert got == seen


def test_scalars(spark):
    df = spark.createDataFrame([(12, 2), (1234567, 12)], "n int, m int")
    assert [tuple(r) for r in df.select(scalars.serial(F.col("n")), scalars.month_name(F.col("m"))).collect()] == [("000012", "FEB"), ("1234567", "DEC")]
    code = scalars.pair_code(F.col("n"), F.col("m"))
    a, b = scalars.pair_of_code(code)
    assert df.where((a != F.col("n")) | (b != F.col("m"))).count() == 0
    box = df.limit(1).select(scalars.box_text(F.lit(10.0), F.lit(80.0), F.lit(-90.0), F.lit(70.0)))
    assert box.head()[0] == "10°N to 80°N, 90°W to 70°E"
    odd = df.limit(1).select(scalars.box_text(F.lit(-0.4), F.lit(2.5), F.lit(0.5), F.lit(1.5)))
    assert odd.head()[0] == "0°S to 2°N, 0°E to 2°E"
    with pytest.raises(Exception, match="no exact code"):
        df.select(scalars.pair_code(F.lit(1 << 44), F.col("n"))).collect()
    m = scalars.MOST_SUM
    far = spark.createDataFrame([(0, m), (m, 0), (m // 2, m // 2 - 1)], "n long, m long").withColumn("code", scalars.pair_code(F.col("n"), F.col("m")))
    a, b = scalars.pair_of_code(F.col("code"))
    assert far.where((a != F.col("n")) | (b != F.col("m"))).count() == 0


def test_quantise_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.2,), (0.19,)], "value double")
    assert [r[0] for r in df.select(raster.over(F.col("value"), 0.2)).collect()] == [0, 0, 1, 0]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    store.append(cells(spark, [(0, 0, 0)]), path)
    store.append(cells(spark, [(1, 0, 0)]), path)
    with pytest.raises(ValueError):
        store.append(cells(spark, [(3, 0, 0)]), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        store.joined(cells(spark, [(0, 0, 0)]), cells(spark, [(1, 1, 0)]))
    store.save_state(cells(spark, [(0, 0, 0)]), f"{path}-state", 1)
    store.save_state(cells(spark, [(5, 0, 0)]), f"{path}-state", 2)
    assert store.load_state(spark, f"{path}-state").head().t == 5 and store.load_state(spark, f"{path}-state", 1).head().t == 0


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(12.5, 33.0), (-70.0, -100.0)], "lat double, lon double")
    x, y = grid.sinusoidal(F.col("lat"), F.col("lon"), False)
    lat, lon = grid.from_sinusoidal(F.col("x"), F.col("y"))
    got = df.withColumn("x", x).withColumn("y", y).select((lat - F.col("lat")).alias("a"), (lon - F.col("lon")).alias("b")).collect()
    assert all(abs(v) < 1e-9 for r in got for v in r)


def test_ellipsoid_round_trip(spark):
    df = spark.createDataFrame([(12.5, 33.0), (-70.0, -100.0), (0.0, 0.0), (89.0, 5.0)], "lat double, lon double")
    x, y = grid.sinusoidal(F.col("lat"), F.col("lon"))
    lat, lon = grid.from_sinusoidal(F.col("x"), F.col("y"), True)
    got = df.withColumn("x", x).withColumn("y", y).select((lat - F.col("lat")).alias("a"), (lon - F.col("lon")).alias("b"), "y").collect()
    assert all(abs(v) < 1e-6 for r in got for v in r[:2])
    # Snyder's example for Clarke's spheroid has other constants; on WGS 84 a quarter of a meridian is 10,001,966 m.
    quarter = spark.range(1).select(grid.sinusoidal(F.lit(90.0), F.lit(0.0))[1]).head()[0]
    assert abs(quarter - 10_001_965.73) < 0.1


def test_project_there_and_back(spark):
    # A plane is linear in both directions, so it comes back but for cells at the rim.
    places = raster.spine(spark, 0, 0, 12, 12).select("yi", "xi", (F.col("yi") * 0.5 + 10).alias("lat"), (F.col("xi") * 0.5 - 3).alias("lon"))
    flat = places.select(F.lit(1).alias("t"), "yi", "xi", (F.col("lat") * 10).alias("value"))
    there, ys, xs = grid.project(flat, places, 10.0, 0.5, -3.0, 0.5, 12, 12, 20_000.0)
    y0, x0 = ys.agg(F.min("y")).head()[0], xs.agg(F.min("x")).head()[0]
    back = grid.project_back(there, places, y0, x0, 20_000.0, ys.count(), xs.count())
    both = back.join(flat.withColumnRenamed("value", "was"), ["t", "yi", "xi"]).where("value is not null").collect()
    assert len(both) > 80 and all(abs(r.value - r.was) < 0.01 for r in both)
    assert ys.select("y").head(2)[1][0] - y0 == 20_000.0 and there.agg(F.max("t")).head()[0] == 1


def test_label_places_are_clamped_before_rounding(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 23, 23), ("c", 5, 6), ("c", 6, 7)], "id string, yi int, xi int")
    got = {r.id: (r.cy, r.cx) for r in overlay.label_places(df, 24, 24, "id").collect()}
    # Halves go to the even number, and the upper bound is the length less the padding.
    assert got == {"a": (1, 2), "b": (23, 22), "c": (6, 6)}


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as a", "id % 3 as b").repartition(7)
    got = tracking.numbered(df, "b", "a", first=5).collect()
    want = {(r.b, r.a): k + 5 for k, r in enumerate(sorted(got, key=lambda r: (r.b, r.a)))}
    assert len(got) == 1000 and all(r.number == want[r.b, r.a] for r in got)


def test_histories_are_folded_apart(spark):
    # Two regions far from each other, and one that splits: groups of the fold hold one history each.
    mask = row0(spark, [(0, 4), (10, 14)], [(1, 5), (10, 14)], [(1, 2), (4, 5), (11, 14)], [(11, 14)])
    own = components.label_frames(mask, 20)
    apart = {(r.t, r.x0): r.label for r in tracking.track(own, 20, 20).collect()}
    days = spark.createDataFrame([(0, t) for t in range(4)], "window_id int, t int")
    assert apart == {(r.t, r.x0): r.label for r in tracking.track(own, 20, 20, windows=days).collect()}


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    from eddyline.plans import analysis
    from eddyline.sources.scratch import written

    own = written(queries.mask(spark, DATA), "mask")
    want = sorted(map(tuple, analysis.windowed_labels(own, queries.SETTINGS, queries.FIRST, queries.LAST).select("t", "yi", "xi", "label").collect()))
    for last in (queries.FIRST + 10, queries.FIRST + 19, queries.LAST):
        got = analysis.extended(raster.days(own, queries.FIRST, last), queries.SETTINGS, queries.FIRST, last, f"file://{tmp_path}/state")
    assert sorted(map(tuple, got.select("t", "yi", "xi", "label").collect())) == want


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from eddyline.sources import scratch

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: {}))
    before, scratch._own[:] = list(scratch._own), []
    try:
        with pytest.raises(RuntimeError):
            scratch.shared_dir(far)
    finally:
        scratch._own[:] = before
    with pytest.raises(ZeroDivisionError), scratch.only_last(spark):
        lost = scratch.written(spark.range(3), "lost")
        raise ZeroDivisionError
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(lost.inputFiles()[0])


def test_saved_events_by_year(spark, tmp_path):
    found = spark.createDataFrame([("EV_000001_JAN_2024", 1), ("EV_000002_DEC_2023", 2)], "id string, serial int")
    own = spark.createDataFrame([("EV_000001_JAN_2024", 5, 0, 0), ("EV_000002_DEC_2023", 1, 2, 2)], "id string, t int, yi int, xi int")
    store.save_events(found, own, f"file://{tmp_path}/ev")
    one = store.load_event(spark, f"file://{tmp_path}/ev", "EV_000002_DEC_2023")
    assert [(r.t, r.yi) for r in one.collect()] == [(1, 2)] and "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_spans_and_stretches(spark):
    df = spark.createDataFrame([(0, 5, 3, 9), (0, 5, 5, 9), (0, 2, 3, 4)], "a int, b int, c int, d int")
    got = df.select(scalars.shared_days(*map(F.col, "abcd")).alias("x")).collect()
    assert [r.x and tuple(r.x) for r in got] == [(3, 5), None, None] == [overlap_of_days((r.a, r.b), (r.c, r.d)) for r in df.collect()]
    one, two = cells(spark, [(0, 0, 0), (0, 1, 1)]), cells(spark, [(1, 1, 0), (1, 0, 1)])
    assert store.joined(one, two).count() == 4


def test_steps():
    from eddyline.plans.timing import Steps

    steps = Steps()
    for name in ("a", "b", "a"):
        with steps(name):
            sum(range(20_000 if name == "a" else 10))
    assert [r[0] for r in steps.table()] == ["a", "b"] and abs(sum(r[2] for r in steps.table()) - 1) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    from eddyline.streaming.tracker import track_stream

    mask = queries.mask(spark, DATA)
    batch = {(r.t, r.yi, r.x0): r.label for r in tracking.track(components.label_frames(mask, 24), 24, 576).collect()}
    days = sorted(r.t for r in mask.select("t").distinct().collect())
    mask.cache()
    schema = "region string, t int, yi int, xi int"
    for k in range(0, len(days), 10):
        mask.where(F.col("t").isin(days[k : k + 10])).select(F.lit("r").alias("region"), "t", "yi", "xi").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = track_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 24, 24)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    got = {(r.t, r.yi, r.x0): r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == batch


def test_no_cross_joins_on_cells(spark):
    plan = queries.overlap_pairs(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["events_table", "frame_components", "overlap_iou", "track_labels", "relabel_overlap", "polygon_mask", "reproject_bilinear", "events_windowed", "fill_small_holes", "project_raster", "project_back", "labels_back", "input_path", "extended_batches", "saved_events", "full_label_map", "label_places", "box_text", "all_codes", "vector_mask", "stream_tracks"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{DATA}/events.parquet'")
    want = db.execute(oracles.SQL[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    tidy = lambda rows: sorted((tuple(round(float(v), 3) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)
    expected = tidy([tuple(r[i] for i in at) for r in want.fetchall()])
    got = tidy(queries.QUERIES[name](spark, DATA).select(*names).collect())
    assert got == expected


def test_stride_counts_from_the_axis(spark, tmp_path):
    # Day 10 has rows 1 to 5, day 11 rows 0 to 5: both days keep rows 0, 2 and 4 of the axis.
    from eddyline.config import Axis

    rows = [(t, y, 0, float(y), 0.0, 1.0) for t in (10, 11) for y in range(6) if (t, y) != (10, 0)]
    spark.createDataFrame(rows, "t int, yi int, xi int, lat double, lon double, v double").write.parquet(f"{tmp_path}/r")
    axes = Axis(0.0, 1.0, 6), Axis(0.0, 1.0, 1)
    got = lambda first, last: {(r.t, r.yi, r.lat) for r in raster.load(spark, f"{tmp_path}/r", "v", first, last, (0.0, 5.0, 0.0, 0.0), 2, axes).collect()}
    assert got(10, 10) == {(10, 1, 2.0), (10, 2, 4.0)}
    assert got(10, 11) == {(10, 1, 2.0), (10, 2, 4.0), (11, 0, 0.0), (11, 1, 2.0), (11, 2, 4.0)}
    assert (axes[0].first(1.5), axes[0].first(2.0), axes[0].last(4.9), axes[0].last(-1), axes[0].first(99)) == (2, 2, 4, -1, 6)
    with pytest.raises(ValueError):
        raster.load(spark, f"{tmp_path}/r", "v", 10, 11, (0.0, 5.0, 0.0, 0.0), 2)


def test_windows_cover_days_without_labels(spark):
    # Windows 0 (days 0..6) and 1 (days 5..9): a cell on day 5 in the one, on day 6 in the other; both days are shared.
    own = spark.createDataFrame([(0, 5, 0, 0, 1), (1, 6, 0, 0, 2)], "window_id int, t int, yi int, xi int, label long")
    days = spark.createDataFrame([(0, 0, 6), (1, 5, 9)], "window_id int, first int, last int")
    assert {tuple(r) for r in windows.label_pairs(own, days).collect()} == {(1, 1), (2, 2)}
    same = spark.createDataFrame([(0, 5, 0, 0, 1), (1, 5, 0, 0, 2), (0, 2, 0, 0, 7), (1, 9, 0, 0, 8)], "window_id int, t int, yi int, xi int, label long")
    assert {tuple(r) for r in windows.label_pairs(same, days).collect()} == {(1, 2)}
