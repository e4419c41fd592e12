"""Exact de-duplication by two-pass Bloom filtering.

Pass 1 reads every text once and stores slim rows: doc_id, a key of the text, and the SHA-256 of
the normalised text. Each task then sorts the places of all its digests in a Bloom filter
of one probe and BITS bits a row, and sends them coded by their differences, some two bytes a
row, to the owners of the filter's parts. What an owner gets twice may be repeated; these
places make up the second filter, of several probes and of MOST_BYTES at most, whatever the input: where there are
so many that they have less than SECOND_BITS bits each, more rows count as possible repeats.
Pass 2 probes that filter, in one pass over the slim rows: rows outside it are unique and pass
straight through; only the possible repeats shuffle, as slim rows, on their full SHA-256, which decides.

Texts are equal when identical after lower-casing A-Z only; null counts as empty; texts of
any length are whole. The largest doc_id of a group stays (null is the smallest); of repeated
rows with that doc_id one stays. An empty table gives an empty result. Columns other than
doc_id and text don't matter, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, cut, mix, partitions, plain, tidy, whole_row, written

#: Bits of the first filter for each row, and rows for one of its parts.
BITS, PART = 64, 1_000_000
#: The second filter: bits and probes of each place; its bytes at most.
SECOND_BITS, PROBES, MOST_BYTES = 16, 4, 256 << 20
#: The second filter is broadcast in pieces of at most so many bytes; a task holds one piece at a time.
FILTER_BYTES = 32 << 20
#: Digests whose places a task sends, or probes, at a time.
ROWS = 1_000_000


def _digests(texts: pa.Array) -> list[bytes]:
    return [hashlib.sha256(x.lower()).digest() for x in pc.cast(plain(texts), pa.binary()).to_pylist()]  # bytes.lower is A-Z only


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (with doc_id it tells a row's copies) and the SHA-256 of the normalised text, for every row.

    Hashing is done in Python on purpose: no JVM function lower-cases A-Z only but ``translate``, which looks up each character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(_digests(part.column("text")), pa.binary())], ["doc_id", "text_key", "digest"])
        tidy()

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, digest binary")


def _keyed(docs: DataFrame, *more: F.Column) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(*more, docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def _keys(column: pa.Array) -> np.ndarray:
    """Digests as four 64-bit words each."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, "<u8").reshape(-1, 4)


def coded(values: np.ndarray) -> bytes:
    """Rising whole numbers by their differences, in groups of seven bits, the last of each marked."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    size = np.ones(len(steps), np.int64)
    for k in range(1, 9):
        size += steps >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(9):
        on = size > k
        out[ends[on] - size[on] + k] = (steps[on] >> 7 * k) & 127
    out[ends - 1] |= 128
    return out.tobytes()


def decoded(stored: bytes) -> np.ndarray:
    raw = np.frombuffer(stored, np.uint8)
    ends = np.flatnonzero(raw & 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    owner = np.repeat(np.arange(len(ends)), ends - starts + 1)
    steps = np.zeros(len(ends), np.int64)
    np.add.at(steps, owner, (raw & 127).astype(np.int64) << 7 * (np.arange(len(raw)) - starts[owner]))
    return np.cumsum(steps)


def _probes(places: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """So many bits of the second filter for each place of the first."""
    h = mix(places.astype(np.uint64))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(probes)], 1).astype(np.int64)


def _filter(places: np.ndarray, each: float, probes: int) -> bytes:
    """A filter of some places with so many bits for each, and 64 bits at least."""
    bits = np.zeros(max(64, -(-int(len(places) * each) // 8) * 8), np.uint8)
    bits[_probes(places, len(bits), probes).ravel()] = 1
    return np.packbits(bits).tobytes()


def _inside(places: np.ndarray, stored: bytes, probes: int) -> np.ndarray:
    raw = np.frombuffer(stored, np.uint8)
    at = _probes(places, 8 * len(raw), probes)
    return ((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def sized(places: int, most_bytes: int) -> tuple[float, int]:
    """(bits for each place, probes) of a second filter of so many places."""
    each = min(float(SECOND_BITS), 8.0 * most_bytes / max(1, places))
    return each, max(1, min(PROBES, round(0.7 * each)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's batches as tables of about ROWS rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def flagged(slim: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Slim rows with ``maybe``: false where the digest certainly occurs once. Written, so both kinds are read from one table."""
    spark, n = slim.sparkSession, slim.count()
    parts = max(partitions(spark), -(-n // PART))
    width = max(64, -(-n // parts) * BITS)

    def place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys[:, 0] % np.uint64(parts)).astype(np.int64), (keys[:, 1] % np.uint64(width)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            part, at = place(_keys(table.column("digest").combine_chunks()))
            order = np.lexsort((at, part))
            part, at = part[order], at[order]
            # Twice says as much as more often.
            third = np.zeros(len(at), bool)
            third[2:] = (part[2:] == part[:-2]) & (at[2:] == at[:-2])
            part, at = part[~third], at[~third]
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array([coded(at[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["part", "places"])
        tidy()

    def own(table: pa.Table) -> pa.Table:
        at = np.sort(np.concatenate([decoded(x) for x in table.column("places").to_pylist()]))
        twice = np.unique(at[1:][at[1:] == at[:-1]])
        return pa.table({"part": table.column("part").slice(0, 1), "n": pa.array([len(twice)], pa.int64()), "places": pa.array([coded(twice)], pa.binary())})

    second = written(slim.select("digest").mapInArrow(send, "part long, places binary").groupBy("part").applyInArrow(own, "part long, n long, places binary"), "repeats")
    each, probes = sized(second.agg(F.sum("n")).head()[0] or 0, most_bytes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_filter(decoded(x), each, probes) for x in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(made, pa.binary())], ["part", "bits"])
        tidy()

    built = written(second.where("n > 0").mapInArrow(build, "part long, bits binary"), "filter")
    size = built.agg(F.sum(F.length("bits"))).head()[0] or 0
    pieces = max(1, -(-size // FILTER_BYTES))
    # At most FILTER_BYTES (and a part) reach the driver at once, and most_bytes in all; executors keep the pieces on disk.
    held = [spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in built.where(F.col("part") % pieces == k).collect()}) for k in range(pieces)]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            part, at = place(_keys(table.column("digest").combine_chunks()))
            order, maybe = np.argsort(part, kind="stable"), np.zeros(len(part), bool)
            edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
            for k in range(pieces):
                filters = held[k].value
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    rows = order[a:b]
                    stored = filters.get(int(part[rows[0]]))  # a part without repeats has none
                    if stored:
                        maybe[rows] = _inside(at[rows], stored, probes)
                if pieces > 1:
                    held[k].__dict__.pop("_value", None)  # read again from disk when it is needed again
            yield from table.append_column("maybe", pa.array(maybe)).to_batches()
        tidy()

    return written(slim.mapInArrow(probe, "doc_id long, text_key long, digest binary, maybe boolean"), "flagged")


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Possible repeats by (digest, doc_id, text_key) with their number, and groups by digest. Both are written, so that a join of them can be split where a group is large."""
    own = written(rows.where("maybe").groupBy("digest", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "maybe")
    groups = own.groupBy("digest").agg(F.max(F.struct("doc_id", "text_key")).alias("keep"), F.sum("n").alias("group_size"))
    return own, written(groups, "groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = flagged(written(digests(docs), "digests"))
    own, groups = _groups(rows)
    repeated = own.join(groups, "digest").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    stays = F.struct("doc_id", "text_key").eqNullSafe(F.col("keep")) & (F.col("i") == 1)
    shape = lambda df, keep_id, size, kept: df.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    alone = shape(rows.where(~F.col("maybe")), F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))
    return alone.unionAll(shape(repeated, F.col("keep")["doc_id"], F.col("group_size"), stays))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Only texts of documents that go, or have copies with their own doc_id, are shuffled."""
    own, groups = _groups(flagged(written(digests(docs), "digests")))
    decided = own.join(groups, "digest").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"), F.struct("doc_id", "text_key").eqNullSafe(F.col("keep")).alias("__stays"), "n")
    acts = written(decided.where("not __stays or n > 1"), "acts")
    known, packed = KeyFilter(acts.select(F.col("__text").alias("text_key")), "text_key"), _keyed(docs, whole_row()).drop("text")
    met = known.inside(packed).join(acts, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__text")), "left")
    # Of copies with their own doc_id too one stays.
    once = met.where("__stays").dropDuplicates(["doc_id", "text_key"])
    out = known.outside(packed).select("row").unionAll(met.where("__stays is null").select("row")).unionAll(once.select("row")).select("row.*")
    return out.sparkSession.createDataFrame([], docs.schema).unionAll(out) if out.schema != docs.schema else out
