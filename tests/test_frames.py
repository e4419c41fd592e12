"""Resampling of dense frames: planes come out as planes, triangles are Delaunay's, and strips agree with whole frames."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyline.config import Axis
from eddyline.operators import frames, grid

LAT, LON = Axis(35.0, 2.5, 9), Axis(-40.0, 3.0, 14)


def points(ellipsoid=True):
    lat, lon = frames.coordinates(LAT), frames.coordinates(LON)
    return np.outer(frames.row_scale(lat, ellipsoid), lon), np.repeat(frames.row_y(lat, ellipsoid)[:, None], LON.size, 1)


def raster(spark, values, t=1, gone=()):
    rows = [(t, y, x, float(values[y, x])) for y in range(LAT.size) for x in range(LON.size) if (y, x) not in gone]
    return spark.createDataFrame(rows, "t int, yi int, xi int, value double")


def test_the_projection_is_the_column_functions(spark):
    df = spark.createDataFrame([(la, lo) for la in frames.coordinates(LAT).tolist() for lo in frames.coordinates(LON).tolist()], "lat double, lon double")
    for ellipsoid in (True, False):
        x, y = grid.sinusoidal(F.col("lat"), F.col("lon"), ellipsoid)
        got = np.array([list(r) for r in df.select(x, y).collect()])
        px, py = points(ellipsoid)
        assert np.allclose(got, np.c_[px.ravel(), py.ravel()], rtol=0, atol=1e-6)
        assert np.allclose(frames.row_lat(py[:, 0], ellipsoid), frames.coordinates(LAT), atol=1e-9 if not ellipsoid else 1e-7)


@pytest.mark.parametrize("tile", [10, 60, 500_000])
def test_planes_stay_planes(spark, tile):
    px, py = points()
    plane = lambda x, y: 3 + 2e-6 * x - 5e-6 * y
    out, ys, xs = frames.projected(raster(spark, plane(px, py)), LAT, LON, 90_000.0, tile=tile)
    rows = out.collect()
    assert len(rows) > 300 and len({(r.yi, r.xi) for r in rows}) == len(rows)
    assert max(abs(r.value - plane(xs.at(r.xi), ys.at(r.yi))) for r in rows) < 1e-6


def test_triangles_are_delaunays():
    """No point lies inside of the circle through a triangle's corners, and the triangles fill the strip."""
    way = frames.Triangles(LAT, LON, Axis(0, 1.0, 1), Axis(0, 1.0, 1))
    px, py = points()
    flat = np.c_[px.ravel(), py.ravel()]
    for k in range(LAT.size - 1):
        mid = (py[k, 0] + py[k + 1, 0]) / 2
        inner = px[k : k + 2].mean(0)
        xs = Axis(float(inner[0]), float(inner[-1] - inner[0]) / 400, 401)
        cells, weights = frames.Triangles(LAT, LON, Axis(mid, 1.0, 1), xs).row(0)
        assert (np.isclose(weights.sum(1), 1)).sum() > 390
        for corners in {tuple(sorted(c)) for c, w in zip(cells.tolist(), weights, strict=True) if w.min() > 1e-9}:
            (ax, ay), (bx, by), (cx, cy) = flat[list(corners)]
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
            uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
            radius = np.hypot(ax - ux, ay - uy)
            assert (np.hypot(flat[:, 0] - ux, flat[:, 1] - uy) >= radius * (1 - 1e-9)).all()
    assert way.source == (LAT, LON)


def test_triangles_against_a_search_of_all(spark):
    rng = np.random.default_rng(4)
    values, (px, py) = rng.normal(size=(LAT.size, LON.size)), points()
    gone = {(3, 5), (0, 0)}
    out, ys, xs = frames.projected(raster(spark, values, gone=gone), LAT, LON, 260_000.0)
    got = {(r.yi, r.xi): r.value for r in out.collect()}
    seen = 0
    for i, j in itertools.product(range(ys.size), range(xs.size)):
        x, y = xs.at(j), ys.at(i)
        k = max(0, min(LAT.size - 2, int(np.searchsorted(py[:, 0], y, "right")) - 1))
        a, b, found = px[k], px[k + 1], None
        for n in range(LON.size - 1):
            for low, high, base, top, apex in ((a, b, k, k + 1, 0), (b, a, k + 1, k, 1)):
                middles, own = (high[:-1] + high[1:]) / 2, (low[n] + low[n + 1]) / 2
                m = int((middles < own).sum()) if not apex else int((middles <= own).sum())
                corners = [(low[n], py[base, 0]), (low[n + 1], py[base, 0]), (high[m], py[top, 0])]
                w = np.linalg.solve(np.array([[c[0] for c in corners], [c[1] for c in corners], [1, 1, 1]]), [x, y, 1])
                if w.min() > -1e-12 and found is None:
                    where = [(base, n), (base, n + 1), (top, m)]
                    used = [(v, q) for v, q in zip(where, w, strict=True) if q > 1e-12]
                    found = None if {v for v, _ in used} & gone else sum(q * values[v] for v, q in used)
                    seen += found is not None
        if found is None:
            assert got.get((i, j)) is None
        else:
            assert abs(got[i, j] - found) < 1e-9
    assert seen > 40


def test_bilinear_agrees_with_the_table_of_weights(spark):
    rng = np.random.default_rng(6)
    df = raster(spark, rng.normal(size=(LAT.size, LON.size)), gone={(2, 2)}).unionAll(raster(spark, rng.normal(size=(LAT.size, LON.size)), t=2))
    places = spark.createDataFrame([(la, lo) for la in frames.coordinates(LAT).tolist() for lo in frames.coordinates(LON).tolist()], "lat double, lon double")
    want, ydf, xdf = grid.project(df, places, LAT.start, LAT.step, LON.start, LON.step, LAT.size, LON.size, 200_000.0)
    as_dict = lambda d: {(r.t, r.yi, r.xi): None if r.value is None else round(r.value, 7) for r in d.collect()}
    for tile in (7, 500_000):
        got, ys, xs = frames.projected(df, LAT, LON, 200_000.0, triangles=False, tile=tile)
        assert as_dict(got) == as_dict(want) and (ys.size, xs.size) == (ydf.count(), xdf.count())
    fine = Axis(LAT.start, 0.5, 41), Axis(LON.start, 0.75, 53)
    round_trip = frames.back(got, ys, xs, *fine).where("value is not null")
    assert round_trip.count() > 500
    plan = frames.resampled(df, frames.Triangles(LAT, LON, ys, xs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_defined_edges(spark):
    none = raster(spark, np.zeros((LAT.size, LON.size))).where("false")
    assert frames.projected(none, LAT, LON, 1e6)[0].count() == 0
    one = Axis(10.0, 1.0, 1)
    assert frames.resampled(raster(spark, np.zeros((LAT.size, LON.size))).where("yi = 0"), frames.Triangles(one, LON, Axis(0, 1.0, 2), Axis(0, 1.0, 2))).count() == 0
