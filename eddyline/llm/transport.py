"""MPEG transport streams in binary columns (ISO/IEC 13818-1).

``demux`` reads a stream: program tables (sections reassembled, CRC checked),
continuity counters, elementary packets put together again, time stamps and
random-access points. ``mux`` writes a payload as one private elementary stream.
``parse_streams`` applies ``demux`` to a column and gives one row per packet of an
elementary stream; ``stream_report`` one row per stream. A stream is one value, so
its work stays in one task; tables of streams split freely.

Defined cases: null or empty bytes are a stream without packets; bytes without
sync are counted as lost; packets after a gap belong to no elementary packet until
the next start, and the cut-off one is marked damaged; a repeated packet counts once.
Tables that are not in force yet change nothing; a new version of a table replaces what the
old one said, and a program that it leaves out takes its streams along. Texts of any length are
whole (null: empty), repeated rows get equal results, an empty table gives an empty result;
columns other than those named to an operator don't matter, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, plain, written

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
#: What ``mux`` writes: where its tables and its stream go, the type of private data, a time stamp for each unit (90 kHz) and bytes for each unit.
PMT_PID, STREAM_PID, PRIVATE, TICKS, UNIT = 0x1000, 0x0101, 0x06, 3600, 16_384
#: Every so many units one can be entered at.
ENTRY_EVERY = 4


@dataclass
class Elementary:
    pid: int
    index: int
    offset: int
    random_access: bool
    pts: int | None = None
    dts: int | None = None
    stream_id: int = 0
    damaged: bool = False
    data: bytes = b""
    program: int | None = None
    stream_type: int | None = None


@dataclass
class Transport:
    packets: int = 0
    lost_bytes: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    table_errors: int = 0
    transport_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # number: PID of its map
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)  # PID: (program, type)
    clocks: list[tuple[int, int]] = field(default_factory=list)  # (packet, clock reference)
    units: list[Elementary] = field(default_factory=list)


@functools.cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for value in range(256):
        c = value << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


@functools.lru_cache(1024)
def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a whole section that is right."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _stamped(value: int, mark: int) -> bytes:
    return bytes([mark << 4 | (value >> 30 & 7) << 1 | 1, value >> 22 & 255, (value >> 15 & 127) << 1 | 1, value >> 7 & 255, (value & 127) << 1 | 1])


def _section(table: int, number: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table, 0xB0 | n >> 8, n & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


@functools.cache
def _tables() -> bytes:
    """The two packets that open a stream: its programs, and the map of the only one."""
    programs = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    own = bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255])
    streams = _section(2, 1, own + b"\xf0\x00" + bytes([PRIVATE]) + own + b"\xf0\x00")
    return b"".join((bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff") for pid, section in ((0, programs), (PMT_PID, streams)))


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload`` in units of UNIT bytes, each an elementary packet with a time stamp."""
    out, counter = [_tables()], 0
    start, middle = bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 255]), bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 255])
    for k, at in enumerate(range(0, len(payload), UNIT)):
        own = payload[at : at + UNIT]
        data = b"\0\0\1\xbd" + (len(own) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamped(k * TICKS, 2) + own
        clock = k * TICKS
        field_ = bytes([0x50 if k % ENTRY_EVERY == 0 else 0x10, clock >> 25 & 255, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255, (clock & 1) << 7 | 0x7E, 0])
        room = PACKET - 5 - len(field_)
        field_ += b"\xff" * max(0, room - len(data))
        out.append(start + bytes([0x30 | counter, len(field_)]) + field_ + data[:room])
        counter, at = counter + 1 & 15, room
        while len(data) - at >= 184:
            out.append(middle + bytes([0x10 | counter]) + data[at : at + 184])
            counter, at = counter + 1 & 15, at + 184
        if at < len(data):
            left = len(data) - at
            stuffing = 183 - left
            out.append(middle + bytes([0x30 | counter, stuffing]) + (b"\0" + b"\xff" * (stuffing - 1) if stuffing else b"") + data[at:])
            counter = counter + 1 & 15
    return b"".join(out)


def _elementary(pid: int, index: int, offset: int, entry: bool, data: bytes, damaged: bool) -> Elementary:
    unit = Elementary(pid, index, offset, entry, damaged=damaged)
    if len(data) < 6 or data[:3] != b"\0\0\1":
        unit.damaged, unit.data = True, data
        return unit
    unit.stream_id, length, body = data[3], data[4] << 8 | data[5], 6
    if length:
        unit.damaged |= len(data) < 6 + length
        data = data[: 6 + length]
    # Streams without the optional header: map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 E, directory.
    if unit.stream_id not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):
        if len(data) < 9:
            unit.damaged = True
            return unit
        flags, body = data[7] >> 6, 9 + data[8]
        if flags & 2 and len(data) >= 14:
            unit.pts = _stamp(data[9:14])
        if flags == 3 and len(data) >= 19:
            unit.dts = _stamp(data[14:19])
    unit.data = data[body:]
    return unit


@functools.lru_cache(4096)
def _read_section(section: bytes) -> tuple | None:
    """(table, number, version, entries) of a section whose CRC is right: (program, PID) or (PID, type). The version is -1 where the table is not in force yet."""
    if len(section) < 12 or section_crc(section):
        return None
    table, number, body = section[0], section[3] << 8 | section[4], section[8:-4]
    version = section[5] >> 1 & 31 if section[5] & 1 else -1
    if table == 0:
        return 0, number, version, tuple((body[i] << 8 | body[i + 1], (body[i + 2] & 31) << 8 | body[i + 3]) for i in range(0, len(body) - 3, 4))
    if table == 2 and len(body) >= 4:
        out, i = [], 4 + ((body[2] & 15) << 8 | body[3])
        while i + 5 <= len(body):
            out.append(((body[i + 1] & 31) << 8 | body[i + 2], body[i]))
            i += 5 + ((body[i + 3] & 15) << 8 | body[i + 4])
        return 2, number, version, tuple(out)
    return table, number, version, ()


def demux(data: bytes) -> Transport:
    t = Transport()
    counters: dict[int, int] = {}
    previous: dict[int, bytes] = {}
    sections: dict[int, bytearray] = {}
    gathered: dict[int, list] = {}  # PID: [offset, entry point, parts]
    versions: dict[int, int] = {}  # of the association table under 0, of maps under their program
    end, at = len(data), 0

    def close(pid: int, damaged: bool = False) -> None:
        own = gathered.pop(pid, None)
        if own:
            unit = _elementary(pid, len(t.units), own[0], own[1], b"".join(own[2]), damaged)
            unit.program, unit.stream_type = t.streams.get(pid, (None, None))
            t.units.append(unit)

    def tables(pid: int, payload: bytes, start: bool) -> None:
        if start and payload:
            pointer = payload[0]
            if pid in sections:
                sections[pid] += payload[1 : 1 + pointer]
                drain(pid)
            sections[pid], payload = bytearray(), payload[1 + pointer :]
        if pid in sections:
            sections[pid] += payload
            drain(pid)

    def drain(pid: int) -> None:
        held = sections[pid]
        while len(held) >= 3 and held[0] != 0xFF:
            n = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < n:
                return
            got = _read_section(bytes(held[:n]))
            del held[:n]
            if got is None:
                t.table_errors += 1
            elif got[2] < 0:
                continue  # it holds from a later version on
            elif got[0] == 0 and pid == 0:
                if versions.get(0) != got[2]:  # a new version says anew which programs there are
                    versions.clear()
                    versions[0] = got[2]
                    t.programs.clear()
                t.programs.update({number: map_pid for number, map_pid in got[3] if number})
                for stream in [x for x, (number, _) in t.streams.items() if number not in t.programs]:
                    del t.streams[stream]
            elif got[0] == 2 and t.programs.get(got[1]) == pid:
                if versions.get(got[1]) != got[2]:
                    versions[got[1]] = got[2]
                    for stream in [x for x, (number, _) in t.streams.items() if number == got[1]]:
                        del t.streams[stream]
                t.streams.update({stream: (got[1], kind) for stream, kind in got[3]})
        if held and held[0] == 0xFF:
            del sections[pid]

    while at + PACKET <= end:
        if data[at] != SYNC:
            found = data.find(b"\x47", at + 1)
            while found >= 0 and found + PACKET < end and data[found + PACKET] != SYNC:
                found = data.find(b"\x47", found + 1)
            found = end if found < 0 else found
            t.lost_bytes += found - at
            at = found
            continue
        b1, b3, offset = data[at + 1], data[at + 3], at
        pid = (b1 & 31) << 8 | data[at + 2]
        t.packets += 1
        at += PACKET
        if b1 & 0x80:
            t.transport_errors += 1
            continue
        if pid == NULL_PID:
            continue
        body, entry, jump = offset + 4, False, False
        if b3 & 0x20:
            n = data[body]
            if n and body + 1 < end:
                flags = data[body + 1]
                jump, entry = flags & 0x80, bool(flags & 0x40)
                if flags & 0x10 and n >= 7:
                    c = data[body + 2 : body + 8]
                    base = c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7
                    t.clocks.append((t.packets - 1, base * 300 + ((c[4] & 1) << 8 | c[5])))
            body += 1 + n
        if not b3 & 0x10:
            continue
        counter, last = b3 & 15, counters.get(pid)
        if last is not None and not jump:
            if counter == last and previous[pid] == data[offset:at]:
                t.repeated += 1
                continue
            if counter != last + 1 & 15:
                t.continuity_errors += 1
                close(pid, True)
                sections.pop(pid, None)
        counters[pid] = counter
        previous[pid] = data[offset:at]
        payload = data[body:at]
        if pid == 0 or pid in t.programs.values():
            tables(pid, payload, bool(b1 & 0x40))
        elif b1 & 0x40:
            close(pid)
            gathered[pid] = [offset, entry, [payload]]
        elif pid in gathered:
            gathered[pid][2].append(payload)
    t.lost_bytes += end - at if at < end else 0
    for pid in list(gathered):
        close(pid)
    return t


def feature(t: Transport, payload: bytes) -> str:
    """What the stream shows: packets, units, entry points, time stamps, clock, errors, mean and spread of samples."""
    stamps = [u.pts for u in t.units if u.pts is not None]
    samples = np.frombuffer(payload, np.uint8)
    total, squares = int(samples.sum(dtype=np.int64)), int(np.square(samples, dtype=np.int64).sum())
    return (
        f"packets={t.packets};units={len(t.units)};entries={sum(u.random_access for u in t.units)};pts={min(stamps, default=-1)}-{max(stamps, default=-1)};"
        f"clocks={len(t.clocks)};types={','.join(f'{pid}:{kind}' for pid, (_, kind) in sorted(t.streams.items()))};errors={t.continuity_errors + t.table_errors + t.transport_errors};sum={total};squares={squares}"
    )


_UNITS = "program int, pid int, stream_type int, unit int, offset long, pts long, dts long, random_access boolean, damaged boolean, data binary"
_REPORT = "packets long, lost_bytes long, continuity_errors long, repeated long, table_errors long, transport_errors long, programs int, units long, entries array<struct<pts: long, offset: long>>"


def parse_streams(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per elementary packet of the streams in a binary column; ``key`` is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "media"):
                rows = []
                for k, data in zip(part.column("key").to_pylist(), part.column("media").to_pylist(), strict=True):
                    t = demux(data or b"")
                    for u in t.units:
                        rows.append((k, u.program, u.pid, u.stream_type, u.index, u.offset, u.pts, u.dts, u.random_access, u.damaged, u.data))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    source = df.select(F.col(key).alias("key"), F.col(column).alias("media"))
    kind = source.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, {_UNITS}"
    shape = to_arrow_schema(source.sparkSession.createDataFrame([], ddl).schema)
    return source.mapInArrow(run, ddl).withColumnRenamed("key", key)


def stream_report(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per stream: counts of packets, errors and units, and the time stamps and places where one can enter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "media"):
                rows = []
                for k, data in zip(part.column("key").to_pylist(), part.column("media").to_pylist(), strict=True):
                    t = demux(data or b"")
                    entries = [{"pts": u.pts, "offset": u.offset} for u in t.units if u.random_access]
                    rows.append((k, t.packets, t.lost_bytes, t.continuity_errors, t.repeated, t.table_errors, t.transport_errors, len(t.programs), len(t.units), entries))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    source = df.select(F.col(key).alias("key"), F.col(column).alias("media"))
    kind = source.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, {_REPORT}"
    shape = to_arrow_schema(source.sparkSession.createDataFrame([], ddl).schema)
    return source.mapInArrow(run, ddl).withColumnRenamed("key", key)


def payload_of(text: bytes) -> bytes:
    """The bytes of a text and zeros up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text"):
                texts = pc.cast(plain(part.column("text")), pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(payload_of(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """Read stored streams back: the payload is what the elementary packets hold, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "media"):
                rows = []
                for doc_id, n, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    t = demux(data)
                    payload = b"".join(u.data for u in t.units)
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(t, payload)))
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _DIGEST.split(", ")])

    return media.mapInArrow(run, _DIGEST)


def transport_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a media column of a table, read the table back and describe it."""
    return media_digests(written(media_column(docs), "media"))
