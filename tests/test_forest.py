"""Label groups that grow batch by batch, and windows as they were written, against plain loops."""

import random

from pyspark.sql import functions as F

from eddyline.operators import forest, windows


def plain_groups(batches):
    """For each batch the smallest label of each label's group, by relabelling all."""
    low, out = {}, []
    for pairs in batches:
        for a, b in pairs:
            low.setdefault(a, a)
            low.setdefault(b, b)
            x, y = low[a], low[b]
            low.update({k: min(x, y) for k, v in low.items() if v in (x, y)})
        out.append(dict(low))
    return out


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_batches_against_relabelling(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "forest")
    batches = [[(rng.randrange(60), rng.randrange(60)) for _ in range(12)] for _ in range(3)] + [[(5, 5)], []]
    told = plain_groups(batches)
    for k, pairs in enumerate(batches):
        forest.add(frame(spark, pairs), path, k)
    labels = spark.createDataFrame([(x,) for x in range(61)], "label long")
    for k in (0, 2, 4):
        got = {r.child: r.mother for r in forest.mapping(labels, path, k).collect()}
        assert got == {x: told[k].get(x, x) for x in range(61)}
    # Of several versions at once, each row by its own.
    asked = spark.createDataFrame([(x, k) for x in range(60) for k in (0, 1, 4)], "label long, version int")
    got = {(r.label, r.version): r.root for r in forest.representatives(asked, forest.rows(spark, path), "label", "version").collect()}
    assert got == {(x, k): told[k].get(x, x) for x in range(60) for k in (0, 1, 4)}


def test_work_is_that_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "forest")
    first = forest.add(frame(spark, [(i, i + 1) for i in range(0, 4000, 2)]), path, 0)
    assert first == {"pairs": 2000, "labels": 4000, "written": 2000}
    assert forest.add(frame(spark, [(1, 3), (7, 9_000)]), path, 1) == {"pairs": 2, "labels": 4, "written": 2}
    assert forest.add(frame(spark, [(1, 3)]), path, 1)["written"] == 0  # a batch that is run again
    got = {r.child: r.mother for r in forest.mapping(frame(spark, [(3, 0), (9_000, 0), (2, 0)]).withColumnRenamed("a", "label"), path).collect()}
    assert got == {3: 0, 9_000: 6, 2: 0}


def test_later_merges_dont_show(spark, tmp_path):
    # Labels 1 and 2 of window 0 are one region only in window 2; what windows 0 and 1 gave out keeps both.
    days = windows.window_days(spark, 0, 8, 4, 2)
    rows = [(0, t, 0, x, label) for t in range(5) for x, label in ((0, 1), (5, 2))]
    rows += [(1, t, 0, x, label) for t in range(2, 7) for x, label in ((0, 11), (5, 12))]
    rows += [(2, t, 0, x, 21) for t in range(4, 9) for x in (0, 5)]
    cells = spark.createDataFrame(rows, "window_id int, t int, yi int, xi int, label long")
    written = {(r.t, r.xi): r.label for r in windows.as_written(cells, days, str(tmp_path / "f")).collect()}
    assert written == {(t, x): (2 if x and t < 4 else 1) for t in range(9) for x in (0, 5)}
    pairs = windows.label_pairs(cells, days)
    assert {r.label for r in windows.stitched(cells, windows.label_map(pairs)).collect()} == {1}
    again = windows.as_written(cells.where(F.col("t") < 99), days, str(tmp_path / "f"))
    assert {(r.t, r.xi): r.label for r in again.collect()} == written
