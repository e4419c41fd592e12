"""Connected regions: in frames, in volumes, and holes in them.

Cells become runs (stretches of a row) by window functions, and all later work is on
runs: a frame has far fewer of them. Regions of one frame never leave it, so each frame
is one group for a union-find over its runs; a frame's size is the grid's, not the
input's. Regions in time are components of a graph of frame pieces (``graph``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import connected_components

_RUNS = "t int, yi int, x0 int, x1 int, component long, size long, piece long, piece_size long"


def runs(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells (t, yi, xi and further keys, distinct) as stretches x0..x1 with the same keys."""
    own = ["t", *keys, "yi"]
    order = Window.partitionBy(*own).orderBy("xi")
    at = cells.select(*own, "xi", (F.col("xi") - F.row_number().over(order)).alias("island"))
    return at.groupBy(*own, "island").agg(F.min("xi").alias("x0"), F.max("xi").alias("x1")).drop("island")


def cells_of(run_table: DataFrame) -> DataFrame:
    """The cells of runs, with all other columns."""
    return run_table.withColumn("xi", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def _roots(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """The first run of each run's region; runs are sorted by row and column, and touch when their columns are within ``reach``."""
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ys, begin = np.unique(y, return_index=True)
    ends = dict(zip(ys.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(y)], strict=True), strict=True))
    a, b = x0.tolist(), x1.tolist()
    for row, (i, end) in ends.items():
        if row + 1 not in ends:
            continue
        j, stop = ends[row + 1]
        while i < end and j < stop:
            if a[i] <= b[j] + reach and a[j] <= b[i] + reach:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    return np.array([root(i) for i in range(len(y))], np.int64)


def _frame(width: int, connectivity: int, dust: int):
    def run(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy() for c in ("yi", "x0", "x1"))
        order = np.lexsort((x0, y))
        y, x0, x1 = y[order].astype(np.int64), x0[order].astype(np.int64), x1[order].astype(np.int64)
        first, out = y * width + x0, {}
        for name, size, way in (("component", "size", connectivity), ("piece", "piece_size", dust)):
            roots = _roots(y, x0, x1, 1 if way == 8 else 0)
            out[name], out[size] = first[roots], np.bincount(roots, x1 - x0 + 1, len(y)).astype(np.int64)[roots]
        part = table.take(pa.array(order))
        return pa.table({c: part.column(c) for c in ("t", "yi", "x0", "x1")} | {c: pa.array(out[c]) for c in ("component", "size", "piece", "piece_size")})

    return run


def label_frames(mask: DataFrame, width: int, connectivity: int = 8, dust_connectivity: int = 4) -> DataFrame:
    """Runs with component (its first cell, yi * width + xi, in row-major order) and size, and the piece of it that is connected by ``dust_connectivity``."""
    return runs(mask).groupBy("t").applyInArrow(_frame(width, connectivity, dust_connectivity), _RUNS)


def dust_frames(labelled: DataFrame, least: int) -> DataFrame:
    """Drop pieces of fewer cells. A component's other pieces keep its label; its size is what is left of it."""
    kept = labelled.where(F.col("piece_size") >= least)
    total = F.sum(F.col("x1") - F.col("x0") + 1).over(Window.partitionBy("t", "component"))
    return kept.withColumn("size", total.cast("long"))


#: Columns of a bucket: runs of a row meet only those that share one with them.
BUCKET = 64


def bucketed(run_table: DataFrame, width: int, a: str = "x0", b: str = "x1") -> DataFrame:
    """Runs with ``bucket``, one row for each that they reach into; one bucket for all where a row is that short."""
    if width <= BUCKET:
        return run_table.withColumn("bucket", F.lit(0))
    at = lambda c: F.expr(f"cast({c} div {BUCKET} as int)")
    return run_table.withColumn("bucket", F.explode(F.sequence(at(a), at(b))))


def meeting(both: DataFrame, width: int, a: tuple[str, str] = ("x0", "x1"), b: tuple[str, str] = ("p0", "p1")) -> DataFrame:
    """Of runs joined by bucket those that overlap, once: in the bucket where what they share begins."""
    met = both.where(f"{a[0]} <= {b[1]} and {b[0]} <= {a[1]}")
    return (met if width <= BUCKET else met.where(f"greatest({a[0]}, {b[0]}) div {BUCKET} = bucket")).drop("bucket")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("t", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("size"))


def _volumes(pieces: DataFrame, cells: int, width: int, *same: str) -> DataFrame:
    """Pieces of frames with volume (the least node) and its size; pieces of neighbouring days are joined where they share a cell and the same keys."""
    node = F.col("t").cast("long") * cells + F.col("piece")
    if "window_id" in pieces.columns:  # windows share days
        node, same = node + F.col("window_id").cast("long") * (1 << 44), (*same, "window_id")
    own = pieces.withColumn("node", node)
    later = own.select((F.col("t") - 1).alias("t"), "yi", *same, F.col("x0").alias("__x0"), F.col("x1").alias("__x1"), F.col("node").alias("b"))
    both = bucketed(own.select("t", "yi", *same, "x0", "x1", "node"), width).join(bucketed(later, width, "__x0", "__x1"), ["t", "yi", "bucket", *same])
    edges = meeting(both, width, b=("__x0", "__x1")).select(F.col("node").alias("a"), "b").distinct()
    roots = connected_components(edges)
    sizes = own.groupBy("node").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).join(roots, "node", "left").withColumn("volume", F.coalesce("root", "node"))
    totals = sizes.groupBy("volume").agg(F.sum("n").cast("long").alias("volume_size"))
    return own.join(sizes.join(totals, "volume").select("node", "volume", "volume_size"), "node").drop("node")


def dust_volume(tracked: DataFrame, least: int, cells: int, width: int) -> DataFrame:
    """Drop the face-connected parts, in space and time, of a label that have fewer cells. tracked: runs with piece and label."""
    return _volumes(tracked, cells, width, "label").where(F.col("volume_size") >= least).drop("volume", "volume_size")


def components_3d(mask: DataFrame, width: int, cells: int, least: int = 1) -> DataFrame:
    """Runs with volume (face-connected in space and time, no tracking) and its size, from ``least`` cells on."""
    return _volumes(label_frames(mask, width, 4, 4), cells, width).where(F.col("volume_size") >= least).select("t", "yi", "x0", "x1", "volume", "volume_size")


def _holes(height: int, width: int, most: int):
    def fill(table: pa.Table) -> pa.Table:
        t, label = table.column("t")[0].as_py(), table.column("label")[0].as_py()
        ys, xs = table.column("yi").to_numpy().astype(int), table.column("xi").to_numpy().astype(int)
        # What lies up to most + 1 cells around a label decides: a region that leaves this patch is too large.
        y0, y1 = max(0, ys.min() - most - 1), min(height - 1, ys.max() + most + 1)
        x0, x1 = max(0, xs.min() - most - 1), min(width - 1, xs.max() + most + 1)
        free = np.ones((y1 - y0 + 1, x1 - x0 + 1), bool)
        free[ys - y0, xs - x0] = False
        steps = np.diff(np.pad(free.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        ry, rx0 = np.nonzero(steps == 1)
        _, rx1 = np.nonzero(steps == -1)
        out_y, out_x = [], []
        if len(ry):
            roots = _roots(ry, rx0, rx1 - 1, 0)
            size = np.bincount(roots, rx1 - rx0, len(ry))[roots]
            for y, a, b in zip(ry[size <= most], rx0[size <= most], rx1[size <= most], strict=True):
                out_y += [y + y0] * (b - a)
                out_x += range(a + x0, b + x0)
        n = len(out_y)
        return pa.table({"t": pa.array([t] * n, pa.int32()), "yi": pa.array(out_y, pa.int32()), "xi": pa.array(out_x, pa.int32()), "label": pa.array([label] * n, pa.int64())})

    return fill


def fill_holes(cells: DataFrame, height: int, width: int, most: int = 10) -> DataFrame:
    """Cells (t, yi, xi, label) with small holes filled: for each label, whatever lies in a face-connected region of other cells of at most ``most`` takes the label; of several the largest."""
    filled = cells.select("t", "yi", "xi", F.col("label").cast("long").alias("label")).groupBy("t", "label").applyInArrow(_holes(height, width, most), "t int, yi int, xi int, label long")
    new = filled.groupBy("t", "yi", "xi").agg(F.max("label").alias("new"))
    return cells.join(new, ["t", "yi", "xi"], "full").select("t", "yi", "xi", F.coalesce("new", "label").alias("label"))
