"""Cells in rings, against the even-odd rule cell by cell."""

import random

import pytest

from eddyline.config import Axis
from eddyline.operators import overlay


@pytest.mark.parametrize("lat, lon", [(Axis(0, 1, 20), Axis(0, 1, 25)), (Axis(-3.5, 0.37, 40), Axis(2.25, 0.81, 30))])
def test_rings_against_each_cell(spark, lat, lon):
    rng = random.Random(3)
    point = lambda: (rng.choice([rng.uniform(-5, 26), float(rng.randrange(0, 20))]), rng.choice([rng.uniform(-5, 22), float(rng.randrange(0, 15))]))
    rings = [("A", [point() for _ in range(rng.randrange(3, 9))]) for _ in range(4)] + [("B", [point() for _ in range(7)]), ("C", [(1.0, 1.0), (5.0, 1.0), (3.0, 1.0)]), ("D", [(4.0, 2.0), (9.0, 2.0), (9.0, 6.0), (4.0, 6.0)])]
    df = spark.createDataFrame([(r, [{"x": x, "y": y} for x, y in ring]) for r, ring in rings], "region string, ring array<struct<x:double,y:double>>")
    want = set()
    for region in "ABCD":
        edges = [e for r, ring in rings if r == region for e in zip(ring, ring[1:] + ring[:1], strict=True)]
        for yi in range(lat.size):
            for xi in range(lon.size):
                x, y = lon.at(xi), lat.at(yi)
                cuts = [x1 + (y - y1) / (y2 - y1) * (x2 - x1) for (x1, y1), (x2, y2) in edges if min(y1, y2) <= y < max(y1, y2)]
                if sum(c > x for c in cuts) % 2:
                    want.add((region, yi, xi))
    out = overlay.polygon_cells(df, lat, lon)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and overlay.polygon_cells(df, Axis(0, 1, 0), lon).count() == 0
