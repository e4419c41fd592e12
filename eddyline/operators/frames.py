"""Resampling frame by frame: a day's cells, or those of a strip of target rows, become one dense array, and weights are applied to it.

Where a target cell's source cells are, and with what weight, follows from axes, which are a few numbers: tasks work it out and remember
it, so neither weights nor four rows a target cell are shuffled. The source cells are dealt out once, by day and strip; a
strip has TILE target cells at most and gets the source rows that it needs, so a task's memory doesn't grow with the grid.

Two ways: linear over the triangles between the rows of projected points (``Triangles``), and bilinear between the cells of a regular
grid (``Bilinear``). A value is null where a source cell that counts is missing, and outside of all source cells.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.config import Axis

from .grid import AXIS, E2, SPHERE

#: Target cells of a strip, at most (but for a row, which is never parted).
TILE = 500_000


def row_y(lat: np.ndarray, ellipsoid: bool) -> np.ndarray:
    """y in metres of latitudes on the sinusoidal projection; the same as ``grid.sinusoidal``."""
    phi = np.radians(lat)
    if not ellipsoid:
        return SPHERE * phi
    c = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072)
    return AXIS * (c[0] * phi - c[1] * np.sin(2 * phi) + c[2] * np.sin(4 * phi) - c[3] * np.sin(6 * phi))


def row_scale(lat: np.ndarray, ellipsoid: bool) -> np.ndarray:
    """Metres of x for each degree of longitude."""
    phi = np.radians(lat)
    wide = SPHERE * np.cos(phi) if not ellipsoid else AXIS * np.cos(phi) / np.sqrt(1 - E2 * np.sin(phi) ** 2)
    return np.radians(1.0) * wide


def row_lat(y: np.ndarray, ellipsoid: bool) -> np.ndarray:
    """Latitudes of y in metres: the inverse of ``row_y``, by the rectifying latitude's series."""
    if not ellipsoid:
        return np.degrees(y / SPHERE)
    mu = y / (AXIS * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    terms = (3 * e / 2 - 27 * e**3 / 32, 21 * e**2 / 16 - 55 * e**4 / 32, 151 * e**3 / 96, 1097 * e**4 / 512)
    return np.degrees(mu + sum(c * np.sin(2 * (k + 1) * mu) for k, c in enumerate(terms)))


def coordinates(a: Axis) -> np.ndarray:
    return a.start + np.arange(a.size) * a.step


def projected_axes(lat: Axis, lon: Axis, cell: float, ellipsoid: bool = True) -> tuple[Axis, Axis]:
    """The axes y and x of the regular grid over the projected points of a lat/lon grid, ``cell`` metres a step: from the least value, below the largest."""
    y, x = row_y(coordinates(lat), ellipsoid), np.outer(row_scale(coordinates(lat), ellipsoid), coordinates(lon))
    return tuple(Axis(float(v.min()), cell, max(0, math.ceil((v.max() - v.min()) / cell - 1e-9))) for v in (y, x))


@dataclass(frozen=True)
class Triangles:
    """From a lat/lon grid to a sinusoidal one, linear over the Delaunay triangles between neighbouring rows of projected points.

    On two parallel rows a segment's third corner is told by the order of the segments' middles, as the circle through a segment's
    ends is symmetric about its middle. Points outside of all strips have no value, also where a concave side leaves them inside of the points' convex hull.
    """

    lat: Axis
    lon: Axis
    ys: Axis
    xs: Axis
    ellipsoid: bool = True

    @property
    def source(self) -> tuple[Axis, Axis]:
        return self.lat, self.lon

    @property
    def target(self) -> tuple[Axis, Axis]:
        return self.ys, self.xs

    def source_rows(self, first: int, end: int) -> tuple[int, int]:
        """The first and last source row that target rows need."""
        y = row_y(coordinates(self.lat), self.ellipsoid)
        at = np.searchsorted(y, [self.ys.at(first), self.ys.at(end - 1)], "right")
        return max(0, int(at[0]) - 1), min(self.lat.size - 1, int(at[1]))

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(source cells, weights) of the targets of a row, three each; weight 0 for none."""
        n, width = self.xs.size, self.lon.size
        cells, weights = np.zeros((n, 3), np.int64), np.zeros((n, 3))
        lat, y = coordinates(self.lat), self.ys.at(r)
        rows = row_y(lat, self.ellipsoid)
        if len(rows) < 2 or width < 2 or not rows[0] <= y <= rows[-1]:
            return cells, weights
        k = min(int(np.searchsorted(rows, y, "right")) - 1, len(rows) - 2)
        s = (y - rows[k]) / (rows[k + 1] - rows[k])
        a, b = (scale * coordinates(self.lon) for scale in row_scale(lat[k : k + 2], self.ellipsoid))
        lower = np.argsort(np.r_[a[:-1] + a[1:], b[:-1] + b[1:]], kind="stable") < width - 1  # whether a triangle has two corners below
        i, j = np.r_[0, np.cumsum(lower)], np.r_[0, np.cumsum(~lower)]
        edge = (1 - s) * a[i] + s * b[j]
        x = coordinates(self.xs)
        inside = (x >= edge[0]) & (x <= edge[-1])
        t = np.clip(np.searchsorted(edge, x, "right") - 1, 0, len(lower) - 1)
        below = lower[t]
        i, j = i[t], j[t]
        left = edge[t]
        share = np.clip((x - left) / np.maximum(edge[t + 1] - left, 1e-300), 0, 1)  # how far from one side of the triangle to the other
        cells[:, 0], cells[:, 1], cells[:, 2] = k * width + i, np.where(below, k * width + i + 1, (k + 1) * width + j + 1), (k + 1) * width + j
        along = np.where(below, 1 - s, s) * share
        weights[:, 1] = along
        weights[:, 0], weights[:, 2] = np.where(below, 1 - s - along, 1 - s), np.where(below, s, s - along)
        weights[~inside] = 0
        return np.minimum(cells, self.lat.size * width - 1), weights


@dataclass(frozen=True)
class Bilinear:
    """From a regular grid to places that lie on it at ``place(row)``: coordinates (y, x) of a target row's cells.

    way: "grid" (targets on axes of the same kind), "to" (targets on a sinusoidal grid, source lat/lon) or "from" (targets lat/lon, source sinusoidal).
    """

    lat: Axis
    lon: Axis
    ys: Axis
    xs: Axis
    way: str = "grid"
    ellipsoid: bool = True

    @property
    def source(self) -> tuple[Axis, Axis]:
        return self.lat, self.lon

    @property
    def target(self) -> tuple[Axis, Axis]:
        return self.ys, self.xs

    def place(self, r: int) -> tuple[float, np.ndarray]:
        y, x = self.ys.at(r), coordinates(self.xs)
        if self.way == "to":
            y = float(row_lat(np.array(y), self.ellipsoid))
            return y, x / row_scale(np.array(y), self.ellipsoid)
        if self.way == "from":
            return float(row_y(np.array(y), self.ellipsoid)), x * row_scale(np.array(y), self.ellipsoid)
        return y, x

    def source_rows(self, first: int, end: int) -> tuple[int, int]:
        at = [(self.place(r)[0] - self.lat.start) / self.lat.step for r in (first, end - 1)]
        return max(0, math.floor(at[0] - 1e-9)), min(self.lat.size - 1, math.floor(at[1] + 1e-9) + 1)

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        y, x = self.place(r)
        # To a thousand-millionth of a cell, so that what lies on an edge is inside, however it was computed.
        fy, fx = round((y - self.lat.start) / self.lat.step, 9), np.round((x - self.lon.start) / self.lon.step, 9)
        inside = (fx >= 0) & (fx <= self.lon.size - 1) & (0 <= fy <= self.lat.size - 1)
        sy, sx = min(math.floor(fy), max(0, self.lat.size - 2)), np.minimum(np.floor(fx), max(0, self.lon.size - 2))
        wy, wx = fy - sy, fx - sx
        corners = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
        cells = np.stack([(sy + dy) * self.lon.size + sx + dx for dy, dx in corners], 1)
        weights = np.stack([(wy if dy else 1 - wy) * (wx if dx else 1 - wx) for dy, dx in corners], 1)
        weights[~inside] = 0
        return np.where(weights > 0, cells, 0).astype(np.int64), weights


@functools.lru_cache(maxsize=4)
def _strip(way: Triangles | Bilinear, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(source cells from the strip's first source row, weights) of a strip of target rows. A worker keeps a few strips."""
    rows = [way.row(r) for r in range(first, end)]
    cells, weights = np.concatenate([c for c, _ in rows]), np.concatenate([w for _, w in rows])
    return np.where(weights > 0, cells - way.source_rows(first, end)[0] * way.source[1].size, 0), weights


def strips(way: Triangles | Bilinear, tile: int = TILE) -> list[tuple[int, int]]:
    """(first, end) of the strips of target rows."""
    ys, xs = way.target
    step = max(1, tile // max(1, xs.size))
    return [(a, min(a + step, ys.size)) for a in range(0, ys.size, step)]


def resampled(raster: DataFrame, way: Triangles | Bilinear, tile: int = TILE) -> DataFrame:
    """(t, yi, xi, value) of a raster (t, yi, xi, value) on the target grid; cells without a value are absent, or null where some source cell counts and is missing."""
    spans = strips(way, tile)
    width = way.source[1].size

    def run(table: pa.Table) -> pa.Table:
        first, end = spans[table.column("strip")[0].as_py()]
        low, high = way.source_rows(first, end)
        frame = np.full((high - low + 1) * width, np.nan)
        at = (table.column("yi").to_numpy().astype(np.int64) - low) * width + table.column("xi").to_numpy()
        frame[at] = table.column("value").to_numpy(zero_copy_only=False)
        cells, weights = _strip(way, first, end)
        counts = weights > 0
        values = np.where(counts, frame[cells] * weights, 0.0).sum(1)
        met = np.flatnonzero((counts & ~np.isnan(frame[cells])).any(1))
        y, x = met // way.target[1].size + first, met % way.target[1].size
        out = pa.array(values[met], pa.float64(), mask=np.isnan(values[met]))
        return pa.table({"t": pa.array(np.full(len(met), table.column("t")[0].as_py(), np.int32)), "yi": pa.array(y.astype(np.int32)), "xi": pa.array(x.astype(np.int32)), "value": out})

    own = raster.where(F.col("value").isNotNull()).select(F.col("t").cast("int").alias("t"), "yi", "xi", F.col("value").cast("double").alias("value"))
    if len(spans) == 1:
        dealt = own.withColumn("strip", F.lit(0))
    else:
        # Which strips need a source row: mostly one or two, told by the rows' numbers.
        needed = [(y, k) for k, (a, b) in enumerate(spans) for y in range(way.source_rows(a, b)[0], way.source_rows(a, b)[1] + 1)]
        dealt = own.join(F.broadcast(raster.sparkSession.createDataFrame(needed, "yi int, strip int")), "yi")  # some rows for each row of the grid
    low, high = way.source_rows(0, max(1, way.target[0].size))
    return dealt.where(F.col("yi").between(low, high)).groupBy("t", "strip").applyInArrow(run, "t int, yi int, xi int, value double")


def projected(raster: DataFrame, lat: Axis, lon: Axis, cell: float, ellipsoid: bool = True, triangles: bool = True, tile: int = TILE) -> tuple[DataFrame, Axis, Axis]:
    """A lat/lon raster on the regular sinusoidal grid over its own projected cells, and that grid's axes y and x."""
    ys, xs = projected_axes(lat, lon, cell, ellipsoid)
    way = Triangles(lat, lon, ys, xs, ellipsoid) if triangles else Bilinear(lat, lon, ys, xs, "to", ellipsoid)
    return resampled(raster, way, tile), ys, xs


def back(raster: DataFrame, ys: Axis, xs: Axis, lat: Axis, lon: Axis, ellipsoid: bool = True, tile: int = TILE) -> DataFrame:
    """A raster of a sinusoidal grid on a lat/lon grid, bilinear between the projected cells."""
    return resampled(raster, Bilinear(ys, xs, lat, lon, "from", ellipsoid), tile)
