"""Following regions from day to day by their overlap.

Overlaps are one join of runs and one aggregation. Only they and the components' sizes
enter the fold over days. What never overlaps, over any number of days, can't decide about one
another: the fold runs by connected component of the overlaps (or by window of days, where windows
are given), so a group holds one region's history and no more. Histories are cut into blocks of days: a block
begins with the labels of the last day before it, which are stored, so no group grows with the number of days.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eddyline.functions.scalars import pair_code
from eddyline.sources.scratch import scratch_path, whole, written

from .components import bucketed, meeting
from .graph import connected_components

#: Days that one group holds at most.
BLOCK_DAYS = 100
#: Windows have label spaces of their own.
SPACE = 1 << 44


def overlaps(labelled: DataFrame, width: int, label: str = "component", keys: tuple[str, ...] = ()) -> DataFrame:
    """(t, prev, cur, inter, first_cell): cells that a label of day t shares with one of the day before, and the first of them."""
    now = labelled.select(*keys, "t", "yi", "x0", "x1", F.col(label).alias("cur"))
    then = labelled.select(*keys, (F.col("t") + 1).alias("t"), "yi", F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col(label).alias("prev"))
    both = meeting(bucketed(now, width).join(bucketed(then, width, "p0", "p1"), [*keys, "t", "yi", "bucket"]), width)
    first = F.greatest("x0", "p0")
    inter = F.least("x1", "p1") - first + 1
    return both.groupBy(*keys, "t", "prev", "cur").agg(F.sum(inter).cast("long").alias("inter"), F.min(F.col("yi").cast("long") * width + first).alias("first_cell"))


def overlap_shares(pairs: DataFrame, sizes: DataFrame, label: str = "component") -> DataFrame:
    """Overlaps with both sizes and their union."""
    now = sizes.select("t", F.col(label).alias("cur"), F.col("size").alias("cur_size"))
    then = sizes.select((F.col("t") + 1).alias("t"), F.col(label).alias("prev"), F.col("size").alias("prev_size"))
    return pairs.join(now, ["t", "cur"]).join(then, ["t", "prev"]).withColumn("in_union", F.col("prev_size") + F.col("cur_size") - F.col("inter"))


def label_changes(sizes: DataFrame, pairs: DataFrame, label: str = "label") -> DataFrame:
    """For each label and day: its size, that on the next day (0 when it is gone), what both share, and their union."""
    own = sizes.select("t", F.col(label).alias("label"), "size")
    after = own.select((F.col("t") - 1).alias("t"), "label", F.col("size").alias("next_size"))
    self_ = pairs.where(F.col("prev") == F.col("cur")).select((F.col("t") - 1).alias("t"), F.col("cur").alias("label"), "inter")
    out = own.join(after, ["t", "label"], "left").join(self_, ["t", "label"], "left").fillna(0, ["next_size", "inter"])
    return out.withColumn("in_union", F.col("size") + F.col("next_size") - F.col("inter"))


def fold(components: list[tuple[int, int, int]], pairs: list[tuple[int, int, int, int, int]], cells: int, iou: tuple[int, int] | None, before: dict[int, tuple[int, int]] | None = None, at: int | None = None) -> list[tuple[int, int, int, int]]:
    """(t, component, label, size) for (t, component, size) and (t, prev, cur, inter, first_cell).

    A component takes the label of yesterday with the largest overlap among those whose
    overlap is over ``iou`` of the union with all of that label's cells; of equal ones the
    one met first. Else it starts a label, t * cells + component. ``before`` holds yesterday's
    {component: (label, size)}, of day ``at``.
    """
    today: dict[int, list] = defaultdict(list)
    links: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for t, c, n in components:
        today[t].append((c, n))
    for t, p, c, inter, first in pairs:
        links[t][c].append((p, inter, first))
    out, state = [], dict(before or {})
    for t in sorted(today):
        if at is None or t != at + 1:
            state = {}  # a day without components lies between
        sizes: dict[int, int] = defaultdict(int)
        for label, n in state.values():
            sizes[label] += n
        now = {}
        for c, n in sorted(today[t]):
            shared: dict[int, list] = {}
            for p, inter, first in links[t][c]:
                if p in state:
                    own = shared.setdefault(state[p][0], [0, first])
                    own[0] += inter
                    own[1] = min(own[1], first)
            fit = [(-inter, first, label) for label, (inter, first) in shared.items() if iou is None or inter * iou[1] > iou[0] * (sizes[label] + n - inter)]
            now[c] = (min(fit)[2] if fit else t * cells + c, n)
            out.append((t, c, now[c][0], n))
        state, at = now, t
    return out


_LABELS = "window_id int, t int, component long, label long"


def _windows(cells: int, iou: tuple[int, int] | None, by_window: bool, start: int | None = None):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        w = key[0].as_py() if by_window else 0
        parts = list(zip(*(left.column(c).to_pylist() for c in ("t", "component", "size", "label")), strict=True))
        rows = fold(
            [(t, c, n) for t, c, n, label in parts if label is None],
            list(zip(*(right.column(c).to_pylist() for c in ("t", "prev", "cur", "inter", "first_cell")), strict=True)),
            cells,
            iou,
            {c: (label, n) for _, c, n, label in parts if label is not None},
            None if start is None else start - 1,
        )
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({"window_id": pa.array([w] * len(rows), pa.int32()), "t": pa.array(columns[0], pa.int32()), "component": pa.array(columns[1], pa.int64()), "label": pa.array([w * SPACE + x for x in columns[2]], pa.int64())})

    return run


def _cogrouped(groups: str, sizes: DataFrame, pairs: DataFrame, fold_: Callable) -> DataFrame:
    sizes, pairs = sizes.toDF(*sizes.columns), pairs.toDF(*pairs.columns)  # columns of their own, though both stem from one table
    return sizes.groupBy(groups).cogroup(pairs.groupBy(groups)).applyInArrow(fold_, _LABELS)


def _block(sizes: DataFrame, pairs: DataFrame, cells: int, iou: tuple[int, int] | None, start: int, before: DataFrame | None) -> DataFrame:
    """The labels of a block of days that begins at ``start``; before: (component, size, label) of the day before it.

    What shares a label then is one history, as a match is held against all cells of a label.
    """
    at = lambda day, c: F.col(day).cast("long") * cells + F.col(c)
    edges = pairs.select((at("t", "prev") - cells).alias("a"), at("t", "cur").alias("b"))
    sizes = sizes.select("t", "component", "size", F.lit(None).cast("long").alias("label"))
    if before is not None:
        old = before.select(F.lit(start - 1).alias("t"), "component", "size", "label")
        hub = F.min("component").over(Window.partitionBy("label"))
        edges = edges.unionAll(old.select(at("t", "component").alias("a"), (F.col("t").cast("long") * cells + hub).alias("b")))
        sizes = sizes.unionAll(old)
    roots = connected_components(edges)
    pairs = pairs.withColumn("node", at("t", "cur")).join(roots, "node").withColumnRenamed("root", "history")
    sizes = sizes.withColumn("node", at("t", "component")).join(roots, "node", "left").withColumn("history", F.coalesce("root", "node")).drop("root")
    return _cogrouped("history", sizes, pairs, _windows(cells, iou, False, start if before is not None else None))


def labels_by_block(sizes: DataFrame, pairs: DataFrame, cells: int, iou: tuple[int, int] | None = (1, 5), block: int = BLOCK_DAYS, path: str | None = None) -> DataFrame:
    """(window_id, t, component, label) of components (t, component, size) and their overlaps, block after block of days.

    Each block's labels are a table below ``path`` (a scratch table by default). A run that was stopped goes on after the last
    block that is stored whole; blocks are counted from the first day, so a later run may have more days.
    """
    spark = sizes.sparkSession
    first, last = sizes.agg(F.min("t"), F.max("t")).head()  # one row
    if first is None:
        return spark.createDataFrame([], _LABELS)
    path, before, done = path or scratch_path(spark, "blocks"), None, []
    for start in range(first, last + 1, block):
        end, own = min(start + block, last + 1) - 1, f"{path}/from={start}"
        if not whole(spark, f"{own}/to={end}"):
            inside = F.col("t").between(start, end)
            # Overlaps with the day before are the block's; there is none before the first day.
            found = _block(sizes.where(inside), pairs.where(inside), cells, iou, start, before)
            found.join(sizes.select("t", "component", "size"), ["t", "component"]).write.mode("overwrite").parquet(f"{own}/to={end}")
        done.append(f"{own}/to={end}")
        before = spark.read.parquet(done[-1]).where(F.col("t") == end).select("component", "size", "label")
    return spark.read.parquet(*done).select("window_id", "t", "component", "label")


def track(labelled: DataFrame, width: int, cells: int, iou: tuple[int, int] | None = (1, 5), windows: DataFrame | None = None, block: int = BLOCK_DAYS, path: str | None = None) -> DataFrame:
    """Labelled runs with window_id and label. windows: (window_id, t), each day in one or more; without it all days are one window, and each history of regions that touch is a group, block by block of days."""
    if windows is None:
        own = labelled.withColumn("window_id", F.lit(0))
    else:
        own = labelled.join(F.broadcast(windows), "t")  # one row a day and window, far below a frame's size
    sizes = own.groupBy("window_id", "t", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("size"))
    pairs = overlaps(own, width, keys=("window_id",))
    if windows is None:
        labels = labels_by_block(written(sizes.drop("window_id"), "sizes"), written(pairs, "overlaps"), cells, iou, block, path)
    else:
        labels = _cogrouped("window_id", sizes.withColumn("label", F.lit(None).cast("long")), pairs, _windows(cells, iou, True))
    return own.join(labels, ["window_id", "t", "component"])


def renumbered(df: DataFrame, first: int = 1, label: str = "label") -> DataFrame:
    """Labels in rising order as first, first + 1, ... in column ``number``. Only the distinct labels are ranked."""
    return df.join(numbered(df.select(label).distinct(), label, first=first), label)


def numbered(df: DataFrame, *order: str, first: int = 1, name: str = "number") -> DataFrame:
    """Rows numbered by some columns. They are dealt out in ranges; a range's numbers go on where those before it end, so no task sorts them all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = written(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = before.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__own") + (first - 1)).cast("int")).drop("__range", "__own", "__before")


def all_codes(labels: DataFrame, label: str = "component") -> DataFrame:
    """(t, prev, cur, code) of every label of a day with every one of the day before: a diagnostic, whose pairs grow with the square of a frame's labels."""
    now = labels.select("t", F.col(label).alias("cur")).distinct()
    then = labels.select((F.col("t") + 1).alias("t"), F.col(label).alias("prev")).distinct()
    return then.join(now, "t").withColumn("code", pair_code(F.col("prev"), F.col("cur")))
