"""What the operators of this subpackage share: scratch tables, Arrow batches and words.

Scratch tables are Parquet files below ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs a re-read and never a result.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eddyline.sources.scratch import release, shared_dir, written  # noqa: F401  the operators take them from here

#: Bytes of text that one step in Python handles at a time, whatever Spark's batches hold.
STEP_BYTES = 2 << 20
#: Words that a worker remembers at most; then it forgets all and starts again.
CACHE_WORDS = 800_000


#: Spark's setting, its default, and ours; a text of more bytes is a batch of its own.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", ("268435456b", "256m", "256MB", "268435456", "64MB", "64m", "67108864b", "67108864"), "4m"))


def tune(spark: SparkSession) -> None:
    """Batches of a few MB between Spark and Python, as texts are large and executors hold two copies of each. Settings that differ from Spark's defaults are the caller's and stay."""
    for name, defaults, own in BATCHES:
        if spark.conf.get(name) in defaults:
            spark.conf.set(name, own)


def tidy() -> None:
    """Give free memory back to the system at the end of a task: Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cut(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text; one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    step = (np.cumsum(sizes) // limit).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
        yield batch.slice(int(a), int(b - a))


def plain(texts: pa.Array) -> pa.Array:
    """Null counts as empty."""
    return pc.fill_null(texts, "")


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: codes into ``uniques``, and where each text's begin."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = plain(texts)
        if lower:
            texts = pc.ascii_lower(texts)  # A-Z only
        lists = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets = offsets - offsets[0]
        encoded = values.dictionary_encode()
        codes, self.uniques = np.asarray(encoded.indices).astype(np.int32), encoded.dictionary
        empty = pc.index(self.uniques, "").as_py() if len(self.uniques) else -1
        if empty >= 0:  # white space at the ends of a text leaves an empty word
            real = codes != empty
            offsets = np.r_[0, np.cumsum(real)][offsets]
            codes = codes[real]
        self.codes, self.offsets = codes, offsets

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        unique = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pc.cast(self.uniques, pa.binary()).to_pylist()), np.uint64, len(self.uniques))
        return unique[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int, seed: int = 11) -> np.ndarray:
    """n odd 64-bit factors, the same in each run."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive hashes; empty when there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i, p in enumerate(powers(n)):
        total += h[i : i + len(total)] * p
    return mix(total)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row() -> F.Column:
    """All columns as one struct named ``row``, whatever they are called."""
    return F.struct("*").alias("row")


def row_schema(packed: DataFrame, *more: tuple[str, str]) -> StructType:
    """``row`` as it is in ``packed``, and further (name, type) columns."""
    out = StructType([packed.schema["row"]])
    for name, kind in more:
        out = out.add(name, kind)
    return out


class KeyFilter:
    """A Bloom filter over a long column, of at most MOST_BITS bits (8 MB) whatever the input.

    It tells rows that certainly have none of the keys, so that only the others need a join. Beyond some
    millions of keys it lets more rows through: that costs a shuffle of them and changes no result.
    """

    MOST_BITS, PROBES = 1 << 26, 4

    def __init__(self, keys: DataFrame, column: str):
        self.column = column
        self.bits = bits = min(self.MOST_BITS, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
        places = F.array(*(F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in range(self.PROBES)))
        at = keys.select(F.explode(places).alias("at"))
        found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()  # bits / 64 rows at most
        table = np.zeros(bits // 64, np.int64)
        table[np.asarray(found.column("word"))] = np.asarray(found.column("set"))
        self.held = keys.sparkSession.sparkContext.broadcast(table)

    def places(self) -> F.Column:
        """A row's bits, for ``hit`` inside of a function that Python runs anyway."""
        return F.array(*(F.pmod(F.xxhash64(self.column, F.lit(k)), F.lit(self.bits)) for k in range(self.PROBES)))

    def hit(self, places: pa.Array) -> np.ndarray:
        """Whether rows with these ``places`` may have one of the keys."""
        at = np.asarray(places.flatten())
        return ((self.held.value[at >> 6] >> (at & 63)) & 1).reshape(-1, self.PROBES).all(1)

    def _maybe(self) -> F.Column:
        known = F.arrow_udf(lambda places: pa.array(self.hit(places)), "boolean")
        return known(self.places())

    def inside(self, rows: DataFrame) -> DataFrame:
        """Rows that may have one of the keys."""
        return rows.where(self._maybe())

    def outside(self, rows: DataFrame) -> DataFrame:
        """Rows that certainly have none."""
        return rows.where(~self._maybe())


def spread(*columns) -> F.Column:
    """A 64-bit hash of some columns, for dealing rows out evenly."""
    return F.xxhash64(*columns)
