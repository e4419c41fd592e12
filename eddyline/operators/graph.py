"""Connected components of an edge list, by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Each task first contracts its own edges; then every node comes to point at its
component's smallest node in about log(diameter) rounds. A round is two aggregations
with map-side sums and two joins that AQE may split, so a hub of any size is no
single task's work. Each round's edges are written out, which cuts the lineage. What
contraction leaves of a graph, up to SMALL edges (some 100 MB in a task), one task settles at once;
a larger one shrinks by rounds until a round changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.sources.scratch import written

SMALL = 300_000
#: Rounds of all searches so far, for whoever measures a run.
COUNTS = {"rounds": 0}


def _contract(batches: Iterator[pa.RecordBatch], most: int | None = None, roots: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) with those of one component led to its smallest node; with ``roots`` that one too, to itself. Beyond ``most`` nodes what is known goes out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = pairs if roots else [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(np.asarray(batch.column("u")).tolist(), np.asarray(batch.column("v")).tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if most is not None and len(parent) > most:
            yield flush()
    yield flush()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the component's smallest node.

    Nodes without such an edge are absent: each is its own component.
    """
    found = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u") != F.col("v"))
    found = written(found.mapInArrow(partial(_contract, most=2 * SMALL), "u long, v long"), "edges")
    before = None
    while True:
        if found.limit(small + 1).count() <= small:
            settled = found.coalesce(1).mapInArrow(partial(_contract, roots=True), "u long, v long")
            return settled.select(F.col("u").alias("node"), F.col("v").alias("root"))
        COUNTS["rounds"] += 1
        # Large star: each neighbour above u goes to the smallest of u and its neighbours.
        both = found.unionAll(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its neighbours below go to the smallest of them.
        large = written(large, "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        found = written(lower.distinct(), "edges")
        now = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
