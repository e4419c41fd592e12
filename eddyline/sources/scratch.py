"""Scratch tables below ``spark.checkpoint.dir``: they cut lineages and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a temporary one, on a local master only: executors elsewhere don't see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (_own[0] if _own else None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="eddyline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own.append(f"file://{folder}")
        found = _own[0]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back."""
    path = f"{shared_dir(df.sparkSession)}/eddyline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one's own; it goes with the scratch tables."""
    path = f"{shared_dir(spark)}/eddyline/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table is stored under a path, whole: its writer came to an end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


@contextlib.contextmanager
def only_last(spark: SparkSession) -> Iterator[None]:
    """Of the tables written inside only the last one stays; where the block fails, none."""
    before, done = list(_written), False
    _written.clear()
    try:
        yield
        done = True
    finally:
        last = _written[-1:] if done else []
        _written[:] = _written[: len(_written) - len(last)]
        release(spark)
        _written[:] = before + last


def latest() -> str:
    """The folder of the table that was written last."""
    return _written[-1]


def release(spark: SparkSession, path: str | None = None) -> int:
    """Delete the scratch tables written so far (or one of them), once their results are stored. Returns how many there were."""
    if path is not None:
        if path in _written:
            _written.remove(path)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    jvm, n = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
