"""Centroid clustering: plain Lloyd on vectors of whole numbers.

Vectors are quantised by Spark and written once; every round reads that table, never the source. A round
broadcasts the centroids (k vectors, 8 KB), tells each vector's nearest in NumPy, and gives out at most k rows of sums
a task, which ``groupBy`` merges: k times the dimension reach the driver, whatever the input. Whole numbers make sums
and distances exact, so results don't depend on how rows are dealt out or on a task that is run again.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out;
components beyond +-2^26 after scaling count as that bound, so that a squared distance fits a long; inertias beyond a long
are given as the largest long. Fewer than k kept vectors are as many centroids; none, an empty result. Vectors with one
vec_id are vectors of their own; among starts their order is that of their components. A null vec_id is hashed as
empty text. Columns other than the two named don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: Centroids, rounds, components, and what components are multiplied by before they are cut to whole numbers.
K, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Components beyond this count as it: 64 squares of differences stay below 2^63.
MOST = 1 << 26
#: Vectors that are held against a centroid at a time.
STEP = 4_096


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, q: array<int>) of the vectors with ``size`` components, all of them numbers."""
    own = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v"))
    fits = (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * F.lit(float(scale)))))
    kept = own.where(F.col("v").isNotNull() & F.coalesce(fits, F.lit(False)))
    return kept.select("vec_id", F.transform("v", lambda x: whole(x).cast("int")).alias("q"))


def starts(kept: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the least sha256 of ``1:<vec_id>``: k rows."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's centroid (of equally near ones the first) and squared distance."""
    cluster, distance = np.zeros(len(q), np.int32), np.zeros(len(q), np.int64)
    for a in range(0, len(q), STEP):
        part = q[a : a + STEP].astype(np.int64)
        squared = np.empty((len(part), len(centroids)), np.int64)
        for j, c in enumerate(centroids):
            away = part - c
            squared[:, j] = np.einsum("ij,ij->i", away, away)
        cluster[a : a + STEP] = squared.argmin(1)
        distance[a : a + STEP] = squared.min(1)
    return cluster, distance


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.concatenate(frame["q"].to_list()).reshape(len(frame), -1)


def _sums(held) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = held.value
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for frame in frames:
            if not len(frame):
                continue
            q = _vectors(frame)
            cluster, _ = nearest(q, centroids)
            for j in np.unique(cluster):
                own = q[cluster == j]
                total[j] += own.sum(0, dtype=np.int64)
                count[j] += len(own)
        met = np.flatnonzero(count)
        if len(met):
            yield pd.DataFrame({"cluster": met.astype(np.int32), "n": count[met], "total": list(total[met])})
        tidy()

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each non-empty one is the floor of its vectors' mean, component by component."""
    held = kept.sparkSession.sparkContext.broadcast(centroids)
    parts = kept.select("q").mapInPandas(_sums(held), "cluster int, n long, total array<long>")
    one = parts.select("cluster", "n", F.posexplode("total").alias("at", "part"))
    sums = one.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # k times the dimension at most
        out[r["cluster"], r["at"]] = int(r["total"]) // int(r["n"])
    held.unpersist()
    return out


def _assigned(held) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cluster, distance = nearest(_vectors(frame), held.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})
        tidy()

    return run


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after some rounds, written, and the centroids."""
    kept = written(quantised(vectors, size=size, scale=scale), "quantised")
    centroids = starts(kept, k)
    shape = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], shape), np.zeros((0, size), np.int64)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    return written(kept.mapInPandas(_assigned(held), shape), "assigned"), centroids


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``lloyd``'s rows with the inertia of each one's cluster and of all, and a hash of its final centroid."""
    spark = vectors.sparkSession
    found, centroids = lloyd(vectors, k, rounds, size, scale)
    most = (1 << 63) - 1
    spread = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # k rows
    inertia = min(most, sum(spread.values()))
    rows = [(j, min(most, spread.get(j, 0)), inertia, ",".join(map(str, c.tolist()))) for j, c in enumerate(centroids)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    told = told.withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
