"""What the steps of a run cost."""

from __future__ import annotations

import contextlib
import resource
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from eddyline.operators import graph


def totals(spark: SparkSession) -> dict[str, int]:
    """What the application's executors have done so far: tasks, bytes read, and bytes shuffled; and rounds of component searches."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    own = [executors.apply(k) for k in range(executors.size())]
    return {
        "tasks": sum(e.totalTasks() for e in own),
        "read_bytes": sum(e.totalInputBytes() for e in own),
        "shuffle_bytes": sum(e.totalShuffleWrite() for e in own),
        "rounds": graph.COUNTS["rounds"],
    }


def peak_bytes(spark: SparkSession) -> int:
    """The largest memory so far of a heap of an executor, with what Python on the driver holds."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    heaps = [e.peakMemoryMetrics().get().getMetricValue("JVMHeapMemory") for k in range(executors.size()) if (e := executors.apply(k)).peakMemoryMetrics().isDefined()]
    return max(heaps, default=0) + 1024 * resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


class Steps:
    """Seconds by step, and each step's share of all: ``with steps("track"): ...``; a step that comes again adds up. With a session also what the step did there."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark
        self.seconds: dict[str, float] = {}
        self.done: dict[str, dict[str, int]] = {}

    @contextlib.contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        start, before = time.perf_counter(), totals(self.spark) if self.spark else {}
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start
            if self.spark:
                own = self.done.setdefault(name, dict.fromkeys(before, 0))
                for k, v in totals(self.spark).items():
                    own[k] += v - before[k]

    def table(self) -> list[tuple[str, float, float]]:
        """(step, seconds, share), the longest first."""
        total = sum(self.seconds.values()) or 1.0
        return sorted(((n, s, s / total) for n, s in self.seconds.items()), key=lambda r: -r[1])

    def frame(self) -> DataFrame:
        """The table with what each step did, to be stored beside its results."""
        rows = [(n, s, share, *(self.done[n][k] for k in ("tasks", "read_bytes", "shuffle_bytes", "rounds"))) for n, s, share in self.table()]
        return self.spark.createDataFrame(rows, "step string, seconds double, share double, tasks long, read_bytes long, shuffle_bytes long, rounds long")
