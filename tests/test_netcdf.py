"""NetCDF files that the tests make byte by byte, and files that are written and read back."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyline.config import Axis
from eddyline.sources import netcdf


def by_hand(path, version, values, records=None):
    """A file of the named version, made without the library: time (unlimited) x lat 3 x lon 2, shorts with scale and filling value -9."""
    n = len(values)
    num = lambda x: struct.pack(">Q" if version == 5 else ">I", x)
    text = lambda s: num(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    char = lambda name, s: text(name) + struct.pack(">I", 2) + num(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    off = lambda x: struct.pack(">I" if version == 1 else ">Q", x)

    def head(a, b, c, d):
        out = b"CDF" + bytes([version]) + num(n if records is None else records)
        out += struct.pack(">I", 10) + num(3) + text("time") + num(0) + text("latitude") + num(3) + text("longitude") + num(2)
        out += struct.pack(">I", 0) + num(0) + struct.pack(">I", 11) + num(4)
        out += text("latitude") + num(1) + num(1) + struct.pack(">I", 0) + num(0) + struct.pack(">I", 5) + num(12) + off(a)
        out += text("longitude") + num(1) + num(2) + struct.pack(">I", 0) + num(0) + struct.pack(">I", 5) + num(8) + off(b)
        out += text("time") + num(1) + num(0) + struct.pack(">I", 12) + num(1) + char("units", "hours since 1970-01-02 12:00:00") + struct.pack(">I", 6) + num(8) + off(c)
        out += text("sla") + num(3) + num(0) + num(1) + num(2) + struct.pack(">I", 12) + num(2)
        out += text("_FillValue") + struct.pack(">I", 3) + num(1) + struct.pack(">hxx", -9) + text("scale_factor") + struct.pack(">I", 6) + num(1) + struct.pack(">d", 0.5)
        return out + struct.pack(">I", 3) + num(12) + off(d)

    size = len(head(0, 0, 0, 0))
    body = head(size, size + 12, size + 20, size + 28) + np.array([10, 11, 12], ">f4").tobytes() + np.array([5, 6], ">f4").tobytes()
    for k, frame in enumerate(values):
        body += struct.pack(">d", 24.0 * k) + np.array(frame, ">i2").tobytes()
    path.write_bytes(body)


FRAMES = [[1, 2, 3, 4, -9, 6], [7, 8, 9, 10, 11, 12]]


@pytest.mark.parametrize("version", [1, 2, 5])
def test_versions(spark, tmp_path, version):
    by_hand(tmp_path / "a.nc", version, FRAMES)
    got = {(r.t, r.yi, r.xi, r.lat, r.lon, r.value) for r in netcdf.scan(spark, str(tmp_path), "sla").collect()}
    assert got == {(k + 1, i // 2, i % 2, 10.0 + i // 2, 5.0 + i % 2, v / 2) for k, f in enumerate(FRAMES) for i, v in enumerate(f) if v != -9}


def test_streamed_number_of_records(spark, tmp_path):
    by_hand(tmp_path / "a.nc", 2, FRAMES, records=0xFFFFFFFF)
    assert netcdf.scan(spark, f"file://{tmp_path}/a.nc").count() == 11


def test_only_wanted_bytes_are_read(tmp_path, monkeypatch):
    by_hand(tmp_path / "a.nc", 2, FRAMES * 50)
    r = netcdf.Reader({"path": str(tmp_path / "a.nc"), "first": "31", "last": "40", "slab_bytes": "48"})
    list(r.pushFilters([netcdf.EqualTo(("lat",), 11.0), netcdf.GreaterThanOrEqual(("t",), 33)]))
    parts = r.partitions()
    assert [(p.first, p.end) for p in parts] == [(32, 36), (36, 40)]
    seen, frame = [], netcdf.File.frame
    monkeypatch.setattr(netcdf.File, "frame", lambda self, k, a, b: seen.append((k, a, b)) or frame(self, k, a, b))
    rows = [b for p in parts for b in r.read(p)]
    assert seen == [(k, 1, 2) for k in range(32, 40)] and sum(b.num_rows for b in rows) == 16


def test_filters_reach_the_source(spark, tmp_path):
    by_hand(tmp_path / "a.nc", 2, FRAMES)
    df = netcdf.scan(spark, str(tmp_path)).where((F.col("t") == 2) & (F.col("lon") > 5.5))
    assert {r.value for r in df.collect()} == {4.0, 5.0, 6.0}
    assert netcdf.scan(spark, str(tmp_path), first=50).count() == 0


def test_refused_files(tmp_path):
    with pytest.raises(ValueError, match="HDF5"):
        netcdf.parsed(b"\x89HDF\r\n")
    with pytest.raises(ValueError, match="classic"):
        netcdf.parsed(b"PK\x03\x04")
    (tmp_path / "cut.nc").write_bytes(b"CDF\x01\0\0\0\1\0\0\0\x0a\0\0\0\3")
    with pytest.raises(ValueError, match="cut off"):
        netcdf.Reader({"path": str(tmp_path / "cut.nc")}).partitions()


@pytest.mark.parametrize("version, kind", [(1, "int"), (2, "float"), (5, "double"), (2, "byte"), (2, "short")])
def test_round_trip(spark, tmp_path, version, kind):
    rows = [(f"f{k % 3}", 100 + k % 7, k % 5, k % 4, float(k % 100)) for k in range(400)]
    df = spark.createDataFrame(rows, "file string, t int, yi int, xi int, value double").withColumn("attributes", F.lit('{"ID": "x", "n": 3}'))
    netcdf.save(df, f"file://{tmp_path}/out", Axis(-2, 0.5, 5), Axis(0, 1, 4), "v", kind, fill=0 if kind in ("int", "byte", "short") else float("nan"), version=version)
    best = {}
    for f, t, y, x, v in rows:
        best[f, t, y, x] = max(v, best.get((f, t, y, x), 0))
    got = {(r.file[:-3], r.t, r.yi, r.xi): r.value for r in netcdf.scan(spark, f"{tmp_path}/out/*.nc", "v").where("value <> 0").collect()}
    assert got == {k: v for k, v in best.items() if v}
    h = netcdf.parsed((tmp_path / "out/f0.nc").read_bytes())
    assert h.attributes == {"ID": "x", "n": [3]} and h.records == 7 and h.version == version


def test_long_files_are_parted(spark, tmp_path):
    df = spark.range(25).select(F.lit("e").alias("file"), F.col("id").cast("int").alias("t"), F.lit(0).alias("yi"), F.lit(0).alias("xi"), F.lit(1.0).alias("value"))
    netcdf.save(df, str(tmp_path / "out"), Axis(0, 1, 1), Axis(0, 1, 1), most_frames=10)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["e_0000.nc", "e_0001.nc", "e_0002.nc"]
    assert netcdf.scan(spark, str(tmp_path / "out")).count() == 25


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    good = spark.range(8).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("t"), F.lit(0).alias("yi"), F.lit(0).alias("xi"), F.lit(1.0).alias("value"))
    netcdf.save(good, str(tmp_path / "out"), Axis(0, 1, 2), Axis(0, 1, 2))
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    bad = good.withColumn("file", F.concat("file", F.lit("x"))).withColumn("yi", F.when(F.col("file") == "f5x", 9).otherwise(0))
    with pytest.raises(Exception, match="outside"):
        netcdf.save(bad, str(tmp_path / "out"), Axis(0, 1, 2), Axis(0, 1, 2))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before
    netcdf.save(good.limit(2), str(tmp_path / "out"), Axis(0, 1, 2), Axis(0, 1, 2), overwrite=True)
    assert len(list((tmp_path / "out").iterdir())) == 2
    netcdf.save(good.limit(0), str(tmp_path / "out"), Axis(0, 1, 2), Axis(0, 1, 2))
    assert len(list((tmp_path / "out").iterdir())) == 2
