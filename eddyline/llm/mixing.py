"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are ranked and cut into blocks. With weight share s, the
i-th block (from 0) of a source has release time floor(i / s) and deadline
ceil((i + 1) / s); in each time slot the released block with the earliest
deadline is emitted. One block goes out a slot, so every source stays less than
one block from its share at all times. Weights are whole numbers, so the schedule
repeats after as many slots as they add up to: only that period is simulated, and
a block's slot follows from its number. When a source runs out the shares of those
left are taken anew, from that slot on; no document is dropped.

Sources without a weight of their own, null among them, share the weight of the
rest. The driver sees one count for each weight, and no more.

Defined cases: a null doc_id ranks by its text; rows of one key rank by doc_id, equal rows in any order, as
they can't be told apart; equal deadlines go by the sources' names; a text of any length ranks by a hash of all of it, a null
one by its doc_id alone; an empty table gives an empty schedule; other columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, whole_row, written

BLOCK = 16
REST = ""


def period(weights: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, release, deadline) for each slot of one period, earliest deadline first."""
    total = sum(weights.values())
    ready: list[tuple[int, str, int, int]] = []
    waiting = [(0, name, 0) for name, w in weights.items() if w]
    heapq.heapify(waiting)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, name, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[name]), name, release, i))
        deadline, name, release, i = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a feasible schedule misses no deadline")
        out.append((name, release, deadline))
        heapq.heappush(waiting, ((i + 1) * total // weights[name], name, i + 1))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple]:
    """Until all sources run out: (source, first block, end block, first slot, weight, period, [(slot, release, deadline) of a period])."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        active = {s: weights[s] for s in left}
        slots = period(active)
        rounds = min(left[s] // w for s, w in active.items())
        took = {s: rounds * w for s, w in active.items()}
        length = rounds * len(slots)
        for name, _, _ in slots:  # the last, unfinished period
            if took[name] == left[name]:
                break
            took[name] += 1
            length += 1
        for s, w in active.items():
            own = [(k, r, d) for k, (name, r, d) in enumerate(slots) if name == s]
            if took[s]:
                out.append((s, done[s], done[s] + took[s], start, w, len(slots), own))
            done[s] += took[s]
            left[s] -= took[s]
        left = {s: n for s, n in left.items() if n}
        start += length
    return out


def rank_key() -> Column:
    """What documents of a source are ranked by."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _stream(weights: Mapping[str, int]) -> Column:
    """The weight that a row's source shares."""
    named = [s for s in weights if s != REST]
    source = F.col("source").cast("string")
    return F.when(source.isin(named), source).otherwise(F.lit(REST)) if named else F.lit(REST)


def _phased(rows: DataFrame, plan: DataFrame, block: Column) -> DataFrame:
    """Rows with the phase of their stream that a block falls into. A stream has a row in it for each phase: no more than there are weights, squared."""
    return rows.join(F.broadcast(plan), (F.col("__stream") == F.col("__s")) & (block >= F.col("first")) & (block < F.col("end"))).withColumn("__m", block - F.col("first"))


def schedule(docs: DataFrame, weights: Mapping[str, int], block: int = BLOCK, keep: bool = False, key: str | None = None) -> DataFrame:
    """Every document's place in the mixture: doc_id, source, stream, block, slot, release, deadline, position; with ``keep`` also all columns, as ``row``.

    A document's key is a fair hash, so its share of all keys tells about where it will stand: rows are dealt out by that, once,
    and the exact ranks follow from counts of what lies before each partition. Partitions are stretches of the mixture, in order.

    weights: whole numbers by source; that of REST holds for all other sources. key: the column that holds ``rank_key``, where the text is no longer there.
    """
    if REST not in weights or min(weights.values()) < 1:
        raise ValueError("weights are whole numbers from 1, one of them for REST")
    spark = docs.sparkSession
    rows = docs.select(*([whole_row()] if keep else []), F.col("doc_id").cast("long").alias("__doc"), F.col("source").cast("string").alias("__source"), _stream(weights).alias("__stream"), (F.col(key) if key else rank_key()).alias("__key"))
    totals = {r[0]: r[1] for r in docs.select(_stream(weights).alias("s")).groupBy("s").count().collect()}  # one row a weight at most
    phases_ = phases({s: -(-n // block) for s, n in totals.items()}, weights)
    plan = spark.createDataFrame([(s, i, a, b, at, w, p) for i, (s, a, b, at, w, p, _) in enumerate(phases_)], "__s string, phase int, first long, end long, at long, weight long, period long")
    # At most (number of weights) x (sum of weights) x phases rows, whatever the input.
    due = spark.createDataFrame([(i, k, slot, r, d) for i, (*_, own) in enumerate(phases_) for k, (slot, r, d) in enumerate(own)], "__phase int, k long, in_period long, r long, d long")
    parts, slots = partitions(spark), max(1, sum(-(-n // block) for n in totals.values()))
    size = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("__stream")) if totals else F.lit(1)
    share = F.col("__key") / F.lit(2.0**64) + F.lit(0.5)
    about = F.least(F.floor(share * size), size - 1).cast("long")
    # A block's release time rises with it, and no slot is earlier.
    rows = _phased(rows, plan, F.floor(about / block).cast("long"))
    release = F.col("at") + F.floor(F.col("__m") * F.col("period") / F.col("weight")).cast("long")
    rows = rows.withColumn("__part", F.floor(release * parts / slots).cast("int")).drop(*plan.columns, "__m")
    # As many rows as streams and partitions.
    counts = rows.groupBy("__stream", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("__stream").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.select(F.col("__stream").alias("__os"), F.col("__part").alias("__op"), F.coalesce(before, F.lit(0)).alias("__offset")), "offsets")
    rank = F.row_number().over(Window.partitionBy("__part", "__stream").orderBy("__key", "__doc"))
    ranked = rows.repartitionById(parts, F.col("__part")).withColumn("__n", rank).join(F.broadcast(offsets), (F.col("__stream") == F.col("__os")) & (F.col("__part") == F.col("__op")))
    ranked = ranked.withColumn("__rank", F.col("__offset") + F.col("__n") - 1).withColumn("block", F.floor(F.col("__rank") / block).cast("long"))
    placed = _phased(ranked, plan, F.col("block")).join(F.broadcast(due), (F.col("phase") == F.col("__phase")) & (F.col("__m") % F.col("weight") == F.col("k")))
    base = F.col("at") + F.floor(F.col("__m") / F.col("weight")).cast("long") * F.col("period")
    slot = base + F.col("in_period")
    return placed.select(
        *(["row"] if keep else []), F.col("__doc").alias("doc_id"), F.col("__source").alias("source"), F.col("__stream").alias("stream"), F.col("block"), slot.alias("slot"), (base + F.col("r")).alias("release"), (base + F.col("d")).alias("deadline"),
        (slot * block + F.col("__rank") % block).alias("position"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, int], block: int = BLOCK) -> DataFrame:
    """All documents, with their columns, each partition a sorted stretch of the mixture. Texts move once."""
    return schedule(docs, weights, block, keep=True).sortWithinPartitions("position").select("row.*")
