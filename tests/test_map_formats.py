"""Rasters and shapes that the writers write and the readers read, and files put together by hand."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalspark.operators import terrain
from pedalspark.sources import geotiff, shapefile


def test_raster_round_trip(spark, tmp_path):
    rows = [(r, c, r * 1000.0 + c) for r in range(150) for c in range(40) if (r + c) % 7]
    df = spark.createDataFrame(rows, "row int, col int, z double")
    assert geotiff.write(df, str(tmp_path / "dem"), 680_000.0, 5_150_000.0, 2.5, rows_a_file=64) == 3
    back = geotiff.read(spark, str(tmp_path / "dem"))
    assert back.schema.simpleString() == "struct<path:string,sample:int,row:int,col:int,x:double,y:double,z:double>"
    grid = geotiff.placed(back, 680_000.0, 5_150_000.0, 2.5)
    assert sorted(map(tuple, grid.collect())) == sorted(rows)
    one = back.filter("z = 100003").first()
    assert (one.x, one.y) == (680_000 + 3.5 * 2.5, 5_150_000 - 100.5 * 2.5)
    assert sorted(map(tuple, terrain.slopes(grid, 2.5).collect())) == sorted(map(tuple, terrain.slopes(df, 2.5).collect()))


def tiff(order, kind, z, packing, tile=None, predictor=1):
    """A file as other programs write it: strips of 3 rows or tiles, any order of bytes, packed or not."""
    rows, cols, samples = z.shape
    wide, tall = tile or (cols, 3)
    blocks = []
    for i in range(0, rows, tall):
        for j in range(0, cols, wide):
            b = z[i : i + tall, j : j + wide]
            if tile:
                b = np.pad(b, ((0, tall - b.shape[0]), (0, wide - b.shape[1]), (0, 0)))
            if predictor == 2:
                b = np.concatenate((b[:, :1], np.diff(b, axis=1)), 1)
            raw = b.astype(f"{order}{kind}").tobytes()
            blocks.append(zlib.compress(raw) if packing == 8 else lzw(raw) if packing == 5 else raw)
    sizes = [len(b) for b in blocks]
    places = [8 + sum(sizes[:k]) for k in range(len(sizes))]
    e = {"u": 1, "i": 2, "f": 3}[kind[0]]
    fields = [(256, "H", [cols]), (257, "H", [rows]), (258, "H", [8 * int(kind[1])] * samples), (259, "H", [packing]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [e] * samples)]
    fields += [(322, "H", [wide]), (323, "H", [tall]), (324, "I", places), (325, "I", sizes)] if tile else [(273, "I", places), (278, "H", [tall]), (279, "I", sizes)]
    head, more, at = b"", b"", 8 + sum(sizes)
    behind = at + 2 + 12 * len(fields) + 4
    for tag, form, values in sorted(fields):
        data = struct.pack(f"{order}{len(values)}{form}", *values)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{order}I", behind + len(more))
        more += data if len(data) > 4 else b""
        head += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[form], len(values)) + place
    return struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at) + b"".join(blocks) + struct.pack(f"{order}H", len(fields)) + head + b"\0" * 4 + more


def lzw(data):
    """The format's packing, by the book: codes grow a bit one code early."""
    table, out, width, bits, last = {bytes([i]): i for i in range(256)}, "", 9, 258, b""
    out += f"{256:09b}"
    for byte in data:
        now = last + bytes([byte])
        if now in table:
            last = now
            continue
        out += f"{table[last]:0{width}b}"
        table[now] = bits
        bits += 1
        if bits == (1 << width):
            width += 1
        if bits == 4094:
            out += f"{256:0{width}b}"
            table, width, bits = {bytes([i]): i for i in range(256)}, 9, 258
        last = bytes([byte])
    out += f"{table[last]:0{width}b}" if last else ""
    out += f"{257:0{width}b}"
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


@pytest.mark.parametrize("order, kind, packing, tile, predictor, samples", [("<", "u1", 1, None, 1, 1), (">", "i2", 8, (16, 16), 2, 1), ("<", "f4", 8, None, 1, 2), (">", "f8", 1, (16, 16), 1, 1), ("<", "u2", 5, None, 2, 3)])
def test_files_of_other_programs(spark, tmp_path, order, kind, packing, tile, predictor, samples):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 90, (23, 37, samples)).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiff(order, kind, z, packing, tile, predictor))
    got = {(r["sample"], r["row"], r["col"]): r.z for r in geotiff.read(spark, str(tmp_path)).collect()}
    assert got == {(s, i, j): float(z[i, j, s]) for s in range(samples) for i in range(23) for j in range(37)}


def test_long_lzw():
    data = bytes(np.random.default_rng(2).integers(0, 4, 60_000).astype(np.uint8))
    assert geotiff.unpacked_lzw(lzw(data)) == data


SQUARE = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]
SHAPES = {
    "Point": [[[(11.25, 46.5)]], [[(-1.0, 2.5)]], None],
    "LineString": [[[(0.0, 0.0), (1.0, 2.0), (3.0, 3.0)]], [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0)]], None],
    "Polygon": [SQUARE, [SQUARE[0]], None],
}


@pytest.mark.parametrize("kind", SHAPES)
def test_shapes_round_trip(spark, tmp_path, kind):
    rows = [(i, parts, f"Straße {i}" if i else None, i * 1.25 - 1e-7, bool(i % 2), datetime.date(2020, 1, 1 + i), 7 * i) for i, parts in enumerate(SHAPES[kind] * 4)]
    df = spark.createDataFrame(rows, f"id long, parts {shapefile.PARTS}, name string, total_score double, total_scores boolean, total_score_day date, n int").repartition(3, "id")
    assert shapefile.write(df, str(tmp_path), kind) == 9
    back = shapefile.read(spark, f"file://{tmp_path}")
    assert back.columns == ["path", "record", "kind", "parts", "id", "name", "total_scor", "total_sc_1", "total_sc_2", "n"]
    got = {r.id: r for r in back.collect()}
    for i, parts, name, score, flag, day, n in rows:
        r = got[i]
        assert [[(p.x, p.y) for p in part] for part in r.parts] == [list(map(tuple, part)) for part in parts or []] and r.kind == (kind if parts else None)
        assert (r.name, r.total_scor, r.total_sc_1, r.total_sc_2, r.n) == (name, score, flag, day, n)
    assert len(got) == len(rows)


def test_shapes_without_attributes_and_measured_ones(spark, tmp_path):
    """A hand-made file with heights, which are left out, and no attribute table."""
    body = struct.pack("<i", 11) + struct.pack("<4d", 1.0, 2.0, 3.0, 0.0)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + 8 + len(body)) // 2) + struct.pack("<2i8d", 1000, 11, 1, 2, 1, 2, 0, 0, 0, 0)
    (tmp_path / "z.shp").write_bytes(head + struct.pack(">2i", 1, len(body) // 2) + body)
    rows = shapefile.read(spark, str(tmp_path)).select("kind", F.col("parts")[0][0].alias("p")).collect()
    assert [(r.kind, r.p.x, r.p.y) for r in rows] == [("Point", 1.0, 2.0)]
