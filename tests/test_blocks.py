"""Folds in blocks of days, and runs joined by buckets of columns."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from eddyline.operators import components, tracking


def blobs(spark, seed, days, side):
    """Rectangles that drift, split and meet."""
    rng, cells = random.Random(seed), set()
    own = [(rng.randrange(side), rng.randrange(side), rng.randrange(2, 5), rng.randrange(2, 6)) for _ in range(6)]
    for t in range(days):
        if t == days // 2:
            continue  # a day without any cell
        own = [(y + rng.randrange(-1, 2), x + rng.randrange(-1, 2), max(1, h + rng.randrange(-1, 2)), max(1, w + rng.randrange(-1, 2))) for y, x, h, w in own]
        cells |= {(t, y + dy, x + dx) for y, x, h, w in own for dy in range(h) for dx in range(w) if 0 <= y + dy < side and 0 <= x + dx < side and rng.random() > 0.08}
    return spark.createDataFrame(sorted(cells), "t int, yi int, xi int")


def by_place(df):
    return {(r.t, r.yi, r.x0): r.label for r in df.collect()}


@pytest.mark.parametrize("seed, iou", [(1, (1, 5)), (2, None), (3, (1, 2))])
def test_blocks_agree_with_one_fold(spark, seed, iou):
    labelled = components.label_frames(blobs(spark, seed, 23, 16), 16).cache()
    want = by_place(tracking.track(labelled, 16, 256, iou))
    assert len(set(want.values())) < len(want)
    for block in (1, 4, 9):
        assert by_place(tracking.track(labelled, 16, 256, iou, block=block)) == want


def test_a_label_in_pieces_goes_on_over_a_block(spark):
    # A region parts on day 1; on day 2 its right piece's overlap is held against all of the label, in the same block or not.
    mask = spark.createDataFrame([(0, 0, x) for x in range(12)] + [(1, 0, x) for x in range(12) if x != 6] + [(2, 0, x) for x in (7, 8)], "t int, yi int, xi int")
    labelled = components.label_frames(mask, 20)
    assert by_place(tracking.track(labelled, 20, 20, (1, 5), block=2)) == by_place(tracking.track(labelled, 20, 20, (1, 5)))


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    labelled = components.label_frames(blobs(spark, 4, 20, 14), 14).cache()
    want = by_place(tracking.track(labelled, 14, 196))
    path, real, seen = str(tmp_path / "blocks"), tracking._block, []

    def stop(sizes, pairs, cells, iou, start, before):
        if len(seen) == 3:
            raise RuntimeError("stopped")
        seen.append(start)
        return real(sizes, pairs, cells, iou, start, before)

    monkeypatch.setattr(tracking, "_block", stop)
    with pytest.raises(RuntimeError):
        tracking.track(labelled, 14, 196, block=4, path=path)
    os.remove(f"{path}/from=8/to=11/_SUCCESS")  # the third block wasn't finished
    seen.clear()
    seen.append("room for two more")
    assert by_place(tracking.track(labelled.where("t < 15"), 14, 196, block=4, path=path)) == {k: v for k, v in want.items() if k[0] < 15}
    assert seen[1:] == [8, 12]
    seen[:] = [0]
    assert by_place(tracking.track(labelled, 14, 196, block=4, path=path)) == want
    assert seen[1:] == [12, 16]  # the block of three days is one of four now
    shutil.rmtree(path)


def test_groups_hold_a_block_at_most(spark, monkeypatch):
    mask = spark.range(60).select(F.col("id").cast("int").alias("t"), F.lit(0).alias("yi"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("xi"))
    labelled = components.label_frames(mask, 10)
    sizes, make = [], tracking._cogrouped

    def spy(groups, left, right, fold):
        sizes.append(left.groupBy(groups).count().agg(F.max("count")).head()[0])
        return make(groups, left, right, fold)

    monkeypatch.setattr(tracking, "_cogrouped", spy)
    assert len(set(by_place(tracking.track(labelled, 10, 10, block=7)).values())) == 1
    assert len(sizes) == 9 and max(sizes) == 8  # the day before, too


def test_rows_of_many_runs(spark):
    # 2,000 runs in a row: the join gives those that overlap, and each pair once, also where runs go over buckets.
    rng, width = random.Random(7), 8_000
    rows = [(t, 0, x) for t in (0, 1) for x in range(width) if x % 4 != 3 and rng.random() < 0.97] + [(t, 1, x) for t in (0, 1) for x in range(width) if (x + 30 * t) % 500]
    mask = spark.createDataFrame(rows, "t int, yi int, xi int")
    runs = components.runs(mask)
    now = runs.withColumn("cur", F.col("x0").cast("long")).withColumn("component", F.col("x0").cast("long") + F.col("yi") * width)
    want = {}
    for y in (0, 1):
        one, two = [[(r.x0, r.x1) for r in runs.where((F.col("t") == t) & (F.col("yi") == y)).orderBy("x0").collect()] for t in (0, 1)]
        for a, b in one:
            for c, d in two:
                if a <= d and c <= b:
                    want[a + y * width, c + y * width] = (min(b, d) - max(a, c) + 1, y * width + max(a, c))
    got = tracking.overlaps(now, width)
    assert {(r.prev, r.cur): (r.inter, r.first_cell) for r in got.collect()} == want
    both = components.bucketed(runs.where("t = 0"), width)
    other = components.bucketed(runs.where("t = 1").select((F.col("t") - 1).alias("t"), "yi", F.col("x0").alias("p0"), F.col("x1").alias("p1")), width, "p0", "p1")
    candidates = both.join(other, ["t", "yi", "bucket"])
    assert candidates.where("yi = 0").count() < 20 * len(want) and components.meeting(candidates, width).count() == len(want)
    # Volumes across buckets.
    volumes = components.components_3d(mask.where("yi = 1"), width, 2 * width).select("volume").distinct().count()
    assert volumes == 1
