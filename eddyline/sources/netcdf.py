"""NetCDF files of the classic format (CDF-1, -2 and -5) as a Spark data source, to read and to write.

Reading: a partition is a stretch of frames of one file, and a task reads the bytes of the rows and frames that are asked
for, no others. Bounds come from options (``first``, ``last``: days since 1970-01-01) and from filters on t, yi, xi, lat and lon that Spark
pushes down. Writing: each task writes whole files below a temporary folder; when all tasks are done they are moved to
their names, so a task that fails, or runs twice, leaves nothing half-written. Files are opened by Arrow's file systems (file, s3, gs, hdfs).

NetCDF-4 files are HDF5 and are refused by name; ``nccopy -k cdf5`` makes them classic.

After Unidata, "NetCDF Classic Format Specifications", which is public.
"""

from __future__ import annotations

import fnmatch
import json
import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from eddyline.config import Axis

#: The format's tags, its number types with NumPy's names for them, and how many seconds units of time have.
DIMENSIONS, VARIABLES, ATTRIBUTES, STREAMING = 0x0A, 0x0B, 0x0C, 0xFFFFFFFF
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SECONDS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}
NAMED = {"byte": 1, "short": 3, "int": 4, "float": 5, "double": 6}
#: Bytes of values that a partition reads, and frames a file has at most when events are written.
SLAB, FRAMES = 64 << 20, 3_650
SCHEMA = "file string, t int, yi int, xi int, lat double, lon double, value double"


@dataclass
class Variable:
    name: str
    dims: list[int]
    kind: int
    begin: int = 0
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    """What a file says about itself. ``records`` is None where it was written as a stream: the file's size tells then."""

    version: int
    records: int | None
    dims: list[tuple[str, int]]
    variables: dict[str, Variable]
    attributes: dict = field(default_factory=dict)

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[d][1] for d in v.dims]

    def recorded(self, v: Variable) -> bool:
        """Whether the variable grows with the unlimited dimension, which has length 0 here."""
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def bytes_of(self, v: Variable) -> int:
        """Of all its values, or of a record's."""
        return int(np.prod(self.shape(v)[self.recorded(v) :], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize

    @property
    def record_size(self) -> int:
        own = [self.bytes_of(v) for v in self.variables.values() if self.recorded(v)]
        return own[0] if len(own) == 1 else sum(_padded(n) for n in own)

    def count(self, file_size: int) -> int:
        if self.records is not None:
            return self.records
        first = min((v.begin for v in self.variables.values() if self.recorded(v)), default=file_size)
        return (file_size - first) // max(1, self.record_size)


def _padded(n: int) -> int:
    return -(-n // 4) * 4


class _Bytes:
    """A header's bytes, read one field after the other."""

    def __init__(self, data: bytes, version: int):
        self.data, self.at, self.wide, self.far = data, 4, version == 5, version != 1

    def take(self, form: str) -> int:
        (x,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return x

    def number(self) -> int:
        return self.take(">Q" if self.wide else ">I")

    def offset(self) -> int:
        return self.take(">Q" if self.far else ">I")

    def blob(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise struct.error("more bytes are needed")
        out = self.data[self.at : self.at + n]
        self.at += _padded(n)
        return out

    def text(self) -> str:
        return self.blob(self.number()).decode()

    def listed(self, tag: int) -> range:
        found, n = self.take(">I"), self.number()
        if found not in (0, tag) or (not found and n):
            raise ValueError("this is no list of a NetCDF header")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.listed(ATTRIBUTES):
            name, kind, n = self.text(), self.take(">I"), self.number()
            raw = self.blob(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, TYPES[kind], n).tolist()
        return out


def parsed(data: bytes) -> Header:
    """The header of a file from its first bytes; struct.error where these aren't enough."""
    if data[:4] == b"\x89HDF":
        raise ValueError("this is a NetCDF-4 (HDF5) file; nccopy -k cdf5 makes it a classic one")
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("this is no classic NetCDF file")
    b = _Bytes(data, data[3])
    records = b.number()
    dims = [(b.text(), b.number()) for _ in b.listed(DIMENSIONS)]
    attributes, variables = b.attributes(), {}
    for _ in b.listed(VARIABLES):
        v = Variable(b.text(), [], 0)
        v.dims = [b.number() for _ in range(b.number())]
        v.attributes, v.kind = b.attributes(), b.take(">I")
        b.number()  # its size, which follows from the dimensions
        v.begin = b.offset()
        variables[v.name] = v
    return Header(data[3], None if records == (1 << 64) - 1 or (data[3] != 5 and records == STREAMING) else records, dims, variables, attributes)


def packed(h: Header) -> bytes:
    """A header's bytes; where each variable begins is worked out, and set: those of one size first, then those of records."""

    def write() -> bytes:
        wide, out = h.version == 5, bytearray(b"CDF" + bytes([h.version]))
        number = lambda n: struct.pack(">Q" if wide else ">I", n)
        text = lambda s: number(len(s.encode())) + s.encode().ljust(_padded(len(s.encode())), b"\0")

        def attributes(own: dict) -> bytes:
            made = bytearray(struct.pack(">I", ATTRIBUTES if own else 0) + number(len(own)))
            for name, value in own.items():
                if isinstance(value, str):
                    kind, n, raw = 2, len(value.encode()), value.encode()
                else:
                    values = value if isinstance(value, list) else [value]
                    kind = 4 if all(isinstance(x, int) and abs(x) < 1 << 31 for x in values) else 6
                    n, raw = len(values), np.array(values, TYPES[kind]).tobytes()
                made += text(name) + struct.pack(">I", kind) + number(n) + raw.ljust(_padded(len(raw)), b"\0")
            return bytes(made)

        out += number((STREAMING if not wide else (1 << 64) - 1) if h.records is None else h.records)
        out += struct.pack(">I", DIMENSIONS if h.dims else 0) + number(len(h.dims))
        for name, size in h.dims:
            out += text(name) + number(size)
        out += attributes(h.attributes) + struct.pack(">I", VARIABLES if h.variables else 0) + number(len(h.variables))
        for v in h.variables.values():
            out += text(v.name) + number(len(v.dims)) + b"".join(map(number, v.dims)) + attributes(v.attributes) + struct.pack(">I", v.kind)
            out += number(min(_padded(h.bytes_of(v)), STREAMING)) + struct.pack(">I" if h.version == 1 else ">Q", v.begin)
        return bytes(out)

    at = len(write())
    for grows in (False, True):
        for v in h.variables.values():
            if h.recorded(v) == grows:
                v.begin = at
                at += _padded(h.bytes_of(v))
    return write()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The files of a path: itself, those of a folder that end in .nc, or those whose names fit a pattern in the last part."""
    system, own = opened(path)
    folder, _, last = own.rpartition("/")
    if any(c in last for c in "*?["):
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, last))
    info = system.get_file_info(own)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(own)) if f.is_file and f.extension == "nc" and not f.base_name.startswith(("_", ".")))
    if not info.is_file:
        raise FileNotFoundError(path)
    return [own]


class File:
    """An open file of one variable over (time, row, column)."""

    def __init__(self, system: fs.FileSystem, path: str, variable: str | None):
        self.file, self.path = system.open_input_file(path), path
        self.size, n = self.file.size(), 1 << 15
        while True:
            data = self.read(0, min(n, self.size))
            try:
                self.header = parsed(data)
                break
            except struct.error:
                if n >= self.size:
                    raise ValueError(f"the header of {path} is cut off") from None
                n *= 4
        own = [v for v in self.header.variables.values() if len(v.dims) == 3 and (variable is None or v.name == variable)]
        if not own:
            raise ValueError(f"{path} has no variable {variable or 'of three dimensions'}")
        self.variable = own[0]
        self.names = [self.header.dims[d][0] for d in self.variable.dims]
        self.frames = self.header.count(self.size) if self.header.recorded(self.variable) else self.header.shape(self.variable)[0]

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def axis(self, k: int) -> np.ndarray:
        """The coordinates of the k-th dimension; numbers from 0 where the file has none."""
        v, n = self.header.variables.get(self.names[k]), self.frames if k == 0 else self.header.shape(self.variable)[k]
        if v is None:
            return np.arange(n, dtype=np.float64)
        kind = np.dtype(TYPES[v.kind])
        if not self.header.recorded(v):
            return np.frombuffer(self.read(v.begin, n * kind.itemsize), kind, n).astype(np.float64)
        step = self.header.record_size
        if n * step <= 1 << 20:
            whole = self.read(v.begin, max(0, (n - 1) * step + kind.itemsize)) if n else b""
            return np.array([np.frombuffer(whole, kind, 1, k * step)[0] for k in range(n)], np.float64)
        return np.array([np.frombuffer(self.read(v.begin + k * step, kind.itemsize), kind, 1)[0] for k in range(n)], np.float64)

    def days(self) -> np.ndarray:
        """The days since 1970-01-01 of the frames."""
        own = self.header.variables.get(self.names[0])
        units = re.match(r"(\w+?)s? since (\d+)-(\d+)-(\d+)(?:[T ](\d+):(\d+)(?::(\d+))?)?", str(own.attributes.get("units", ""))) if own else None
        if not units or units[1].lower() not in SECONDS:
            raise ValueError(f"{self.path}: time has no unit such as days since 1970-01-01")
        if str(own.attributes.get("calendar", "standard")).lower() not in ("standard", "gregorian", "proleptic_gregorian"):
            raise ValueError(f"{self.path}: the calendar {own.attributes['calendar']} isn't Gregorian")
        start = (date(*map(int, units.groups()[1:4])) - date(1970, 1, 1)).days * 86_400 + sum(int(x or 0) * s for x, s in zip(units.groups()[4:], (3_600, 60, 1), strict=True))
        return np.floor((self.axis(0) * SECONDS[units[1].lower()] + start) / 86_400).astype(np.int64)

    def frame(self, k: int, first_row: int, end_row: int) -> np.ndarray:
        """Rows of a frame as doubles: unpacked, NaN where the file has its filling value. No other bytes are read."""
        v, kind = self.variable, np.dtype(TYPES[self.variable.kind])
        _, height, width = self.header.shape(v)
        step = self.header.record_size if self.header.recorded(v) else height * width * kind.itemsize
        raw = self.read(v.begin + k * step + first_row * width * kind.itemsize, (end_row - first_row) * width * kind.itemsize)
        own = np.frombuffer(raw, kind).reshape(end_row - first_row, width)
        out = own.astype(np.float64)
        one = lambda name: (x[0] if isinstance(x := v.attributes.get(name), list) and x else x)
        for name in ("_FillValue", "missing_value"):
            if one(name) is not None and not isinstance(one(name), str):
                out[own == np.array(one(name)).astype(kind)] = np.nan
        if one("scale_factor") is not None or one("add_offset") is not None:
            out = out * float(one("scale_factor") or 1) + float(one("add_offset") or 0)
        return out


@dataclass
class Slab(InputPartition):
    path: str
    first: int
    end: int

    def __init__(self, path: str, first: int, end: int):
        super().__init__((path, first, end))
        self.path, self.first, self.end = path, first, end


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options.get("variable")
        self.slab = int(options.get("slab_bytes", SLAB))
        self.bounds: dict[str, tuple[float, float]] = {}
        for name, k in (("first", 0), ("last", 1)):
            if name in options:
                self._bound("t", *((float(options[name]), np.inf) if k == 0 else (-np.inf, float(options[name]))))

    def _bound(self, column: str, low: float, high: float) -> None:
        a, b = self.bounds.get(column, (-np.inf, np.inf))
        self.bounds[column] = max(a, low), min(b, high)

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds choose what is read; Spark still applies every filter, so they may be wider than it."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in ("t", "yi", "xi", "lat", "lon") and isinstance(f.value, (int, float)):
                self._bound(f.attribute[0], -np.inf if isinstance(f, (LessThan, LessThanOrEqual)) else f.value, np.inf if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else f.value)
            yield f

    def _inside(self, column: str, values: np.ndarray) -> np.ndarray:
        low, high = self.bounds.get(column, (-np.inf, np.inf))
        return (values >= low) & (values <= high)

    def partitions(self) -> list[Slab]:
        """Stretches of wanted frames. Of each file only the header and the time axis are read."""
        system, _ = opened(self.path)

        def slabs(path: str) -> list[Slab]:
            f = File(system, path, self.variable)
            wanted = np.flatnonzero(self._inside("t", f.days()))
            if not len(wanted):
                return []
            _, height, width = f.header.shape(f.variable)
            step = max(1, self.slab // max(1, height * width * np.dtype(TYPES[f.variable.kind]).itemsize))
            first, end = int(wanted[0]), int(wanted[-1]) + 1
            return [Slab(path, k, min(k + step, end)) for k in range(first, end, step)]

        with ThreadPoolExecutor(16) as pool:
            return [s for own in pool.map(slabs, files(self.path)) for s in own] or [Slab("", 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        f = File(opened(self.path)[0], partition.path, self.variable)
        days, lat, lon = f.days(), f.axis(1), f.axis(2)
        rows = np.flatnonzero(self._inside("lat", lat) & self._inside("yi", np.arange(len(lat))))
        columns = np.flatnonzero(self._inside("lon", lon) & self._inside("xi", np.arange(len(lon))))
        if not len(rows) or not len(columns):
            return
        name = partition.path.rpartition("/")[2]
        low, high = int(rows[0]), int(rows[-1]) + 1
        for k in range(partition.first, partition.end):
            if not self._inside("t", days[k : k + 1])[0]:
                continue
            values = f.frame(k, low, high)[:, columns[0] : columns[-1] + 1]
            y, x = np.nonzero(~np.isnan(values))
            n = len(y)
            if n:
                yy, xx = y + low, x + int(columns[0])
                own = [pa.array([name] * n), pa.array(np.full(n, days[k], np.int32)), pa.array(yy.astype(np.int32)), pa.array(xx.astype(np.int32)), pa.array(lat[yy]), pa.array(lon[xx]), pa.array(values[y, x])]
                yield pa.RecordBatch.from_arrays(own, ["file", "t", "yi", "xi", "lat", "lon", "value"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Rows (file, t, yi, xi, value, n_frames, attributes) of which each file's lie in one partition, by file and t."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.variable, self.kind = options.get("variable", "value"), NAMED[options.get("type", "float")]
        self.lat, self.lon = (Axis(*(float(x) for x in options[a].split(",")[:2]), int(options[a].split(",")[2])) for a in ("lat", "lon"))
        self.fill, self.version = float(options.get("fill", "nan")), int(options.get("version", 2))
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, own = opened(self.path)
        return system, own, f"{own}/_temporary-{self.job}"

    def header(self, n: int, attributes: dict) -> Header:
        own = {} if np.isnan(self.fill) and self.kind not in (5, 6) else {"_FillValue": [self.fill]} if self.kind in (5, 6) else {}
        variables = [
            Variable("lat", [1], 6, attributes={"units": "degrees_north"}), Variable("lon", [2], 6, attributes={"units": "degrees_east"}),
            Variable("time", [0], 4, attributes={"units": "days since 1970-01-01", "calendar": "standard"}), Variable(self.variable, [0, 1, 2], self.kind, attributes=own),
        ]
        return Header(self.version, n, [("time", 0), ("lat", self.lat.size), ("lon", self.lon.size)], {v.name: v for v in variables}, attributes)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self._folder()
        system.create_dir(folder, recursive=True)
        attempt, names, out = uuid.uuid4().hex, [], None
        height, width = self.lat.size, self.lon.size
        name, day, left = None, None, 0
        frame = np.full((height, width), self.fill)

        def flush() -> None:
            nonlocal left
            if day is not None:
                with np.errstate(invalid="ignore"):
                    raw = frame.astype(TYPES[self.kind]).tobytes()
                out.write(struct.pack(">i", day) + raw.ljust(_padded(len(raw)), b"\0"))
                left -= 1
                frame[:] = self.fill

        def close() -> None:
            if out is not None:
                flush()
                out.close()
                if left:
                    raise ValueError(f"{name} has another number of frames than was told")

        for batch in batches:
            own = {c: batch.column(c) for c in batch.schema.names}
            t, y, x = (np.asarray(own[c]).astype(np.int64) for c in ("t", "yi", "xi"))
            if len(t) and (y.min() < 0 or y.max() >= height or x.min() < 0 or x.max() >= width):
                raise ValueError("a cell lies outside of the axes")
            value = np.asarray(own["value"].cast(pa.float64()).fill_null(self.fill))
            code = own["file"].dictionary_encode()
            at = np.asarray(code.indices)
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (t[1:] != t[:-1])][: len(t)])
            for a, b in zip(cuts, np.r_[cuts[1:], len(t)], strict=True):
                now = code.dictionary[int(at[a])].as_py()
                if now != name:
                    close()
                    name, day = now, None
                    left, told = own["n_frames"][int(a)].as_py(), own["attributes"][int(a)].as_py()
                    names.append((f"{folder}/{attempt}-{name}.nc", f"{name}.nc"))
                    out = system.open_output_stream(names[-1][0])
                    out.write(packed(self.header(left, json.loads(told) if told else {})))
                    out.write(np.array([self.lat.at(k) for k in range(height)], ">f8").tobytes() + np.array([self.lon.at(k) for k in range(width)], ">f8").tobytes())
                if t[a] != day:
                    flush()
                    day = int(t[a])
                frame[y[a:b], x[a:b]] = value[a:b]
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, own, folder = self._folder()
        system.create_dir(own, recursive=True)
        if self.overwrite:
            for path in files(self.path):
                system.delete_file(path)
        for m in messages:
            for temporary, name in m.names if m else []:
                system.move(temporary, f"{own}/{name}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self._folder()
        self._clear(system, folder)

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class NetCDF(DataSource):
    """``spark.read.format("netcdf")``: path, variable, first, last, slab_bytes. Writing: path, variable, type, fill, version, and axes as lat and lon ("start,step,size")."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark push filters down to it."""
    spark.dataSource.register(NetCDF)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, path: str, variable: str | None = None, first: int | None = None, last: int | None = None, **options) -> DataFrame:
    """(file, t, yi, xi, lat, lon, value) of the cells that have a value, in one file, a folder, or the files whose names fit a pattern."""
    register(spark)
    own = {"path": path, "variable": variable, "first": first, "last": last, **options}
    return spark.read.format("netcdf").options(**{k: v for k, v in own.items() if v is not None}).load()


def save(df: DataFrame, path: str, lat: Axis, lon: Axis, variable: str = "value", kind: str = "float", fill: float = float("nan"), most_frames: int = FRAMES, overwrite: bool = False, version: int = 2) -> None:
    """Rows (file, t, yi, xi, value; attributes, a JSON text, where there is one) as a NetCDF file for each ``file``.

    Days without a row have no frame, cells without one the filling value; of rows of one cell and day the largest value is written. A file of more than
    ``most_frames`` frames is several, named by their number, so no task writes without bound.
    """
    register(df.sparkSession)
    own = df if "attributes" in df.columns else df.withColumn("attributes", F.lit(None).cast("string"))
    days = own.groupBy("file", "t").agg(F.max("attributes").alias("attributes"))
    # A file's days are dealt out in stretches of equal length from its first.
    first = days.groupBy("file").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    part = F.expr(f"(t - first) div {int(most_frames)}")
    days = days.join(first, "file").withColumn("name", F.when(F.col("last") - F.col("first") < most_frames, F.col("file")).otherwise(F.concat_ws("_", "file", F.format_string("%04d", part))))
    counts = days.groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
    told = days.join(counts, "name").select("file", "t", "name", "n_frames", "attributes")
    cells = own.groupBy("file", "t", "yi", "xi").agg(F.max("value").cast("double").alias("value")).join(told, ["file", "t"])
    rows = cells.select(F.col("name").alias("file"), F.col("t").cast("int").alias("t"), F.col("yi").cast("int").alias("yi"), F.col("xi").cast("int").alias("xi"), "value", "n_frames", "attributes")
    rows = rows.repartition("file").sortWithinPartitions("file", "t")
    options = {"path": path, "variable": variable, "type": kind, "fill": fill, "version": version} | {name: f"{a.start!r},{a.step!r},{a.size}" for name, a in (("lat", lat), ("lon", lon))}
    rows.write.format("netcdf").mode("overwrite" if overwrite else "append").options(**options).save()
