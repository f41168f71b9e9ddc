"""GeoTIFF rasters, in strips or tiles, with their place on earth.

A file is a row of Spark's binary source, so files are read in parallel and from any store; the cells of a file leave its
task strip by strip. The writer makes a file for each band of rows. Read are plain and packed (deflate, LZW) files of
whole numbers or floats with either order of bytes, several samples and the horizontal predictor; written are deflated
doubles of one sample.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import contents, saved

# Tags of the format and the sizes of its field types.
WIDTH, LENGTH, BITS, PACKING, SAMPLES, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 277, 284, 317, 339
STRIP_AT, STRIP_ROWS, STRIP_BYTES, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES = 273, 278, 279, 322, 323, 324, 325
SCALE, TIE, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
SCHEMA = "path string, sample int, row int, col int, x double, y double, z double"


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(order of bytes, tag -> values) of the first image."""
    order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
    kind = struct.unpack_from(f"{order}H", data, 2)[0]
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    at = struct.unpack_from(f"{order}Q", data, 8)[0] if big else struct.unpack_from(f"{order}I", data, 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at, size, found = at + (8 if big else 2), 20 if big else 12, {}
    for k in range(n):
        tag, type_, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, at + k * size)
        form = _TYPES.get(type_)
        if not form:
            continue
        room, place = (8, at + k * size + 12) if big else (4, at + k * size + 8)
        width = struct.calcsize(f"<{form}") * count
        if width > room:
            place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
        if form == "s":
            found[tag] = (bytes(data[place : place + count]).rstrip(b"\0").decode("latin-1"),)
        else:
            found[tag] = struct.unpack_from(order + form * count, data, place)
    return order, found


def unpacked_lzw(data: bytes) -> bytes:
    """The format's LZW: codes of 9 to 12 bits, highest bits first, 256 clears the table and 257 ends."""
    out, table, width, bits, held, last = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
        last = entry
    return b"".join(out)


def _blocks(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values [rows, columns, samples]) of each strip or tile."""
    order, tags = tags_of(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, length, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    kind = np.dtype(f"{order}{'uif'[one(FORMAT, 1) - 1]}{one(BITS, 8) // 8}")
    packing, predictor, apart = one(PACKING, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and samples > 1
    if TILE_AT in tags:
        wide, tall, places, sizes = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_AT], tags[TILE_BYTES]
    else:
        wide, tall, places, sizes = width, min(length, one(STRIP_ROWS, length)), tags[STRIP_AT], tags[STRIP_BYTES]
    across, down = -(-width // wide), -(-length // tall)
    if apart or predictor not in (1, 2) or packing not in (1, 5, 8, 32946):
        raise ValueError("a TIFF file of another kind")
    for k, (place, size) in enumerate(zip(places, sizes)):
        raw = bytes(data[place : place + size])
        raw = unpacked_lzw(raw) if packing == 5 else zlib.decompress(raw) if packing in (8, 32946) else raw
        row, col = k // across * tall, k % across * wide
        rows = tall if TILE_AT in tags else min(tall, length - row)
        block = np.frombuffer(raw, kind, rows * wide * samples).reshape(rows, wide, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        yield row, col, block[: length - row, : width - col]
    assert len(places) == across * down


def cells(data: bytes) -> Iterator[dict]:
    """The columns sample, row, col, x, y, z of each strip or tile; x and y of the cells' middles, null without a place; no-data cells go."""
    _, tags = tags_of(data)
    scale, tie = tags.get(SCALE), tags.get(TIE)
    none = float(tags[NO_DATA][0]) if NO_DATA in tags else None
    for row, col, block in _blocks(data):
        for sample in range(block.shape[2]):
            z = block[:, :, sample].astype(np.float64)
            keep = ~np.isnan(z) & (z != none if none is not None else True)
            i, j = np.nonzero(keep)
            r, c = i + row, j + col
            x = tie[3] + (c + 0.5 - tie[0]) * scale[0] if scale and tie else np.full(len(r), np.nan)
            y = tie[4] - (r + 0.5 - tie[1]) * scale[1] if scale and tie else np.full(len(r), np.nan)
            yield {"sample": np.full(len(r), sample, np.int32), "row": r.astype(np.int32), "col": c.astype(np.int32), "x": x, "y": y, "z": z[keep]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA: a row for each cell with a value of the ``.tif`` files below ``path``; rows and columns count within a file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                for block in cells(memoryview(batch.column(1)[i].as_buffer())):
                    n = len(block["z"])
                    place = [pa.array(block[c], mask=np.isnan(block[c])) for c in ("x", "y")]
                    columns = [pa.array([name] * n, pa.string()), *(pa.array(block[c]) for c in ("sample", "row", "col")), *place, pa.array(block["z"])]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return contents(spark, path, ".tif").mapInArrow(run, SCHEMA)


def placed(raster: DataFrame, west: float, north: float, cell: float) -> DataFrame:
    """(row, col, z) of one grid over all files, whose first cell's corner is (west, north); of files that overlap the first by name wins."""
    at = {"row": F.floor((north - F.col("y")) / cell).cast("int"), "col": F.floor((F.col("x") - west) / cell).cast("int")}
    return raster.withColumns(at).groupBy("row", "col").agg(F.min_by("z", "path").alias("z"))


def encoded(z: np.ndarray, west: float, north: float, cell: float, epsg: int, rows_a_strip: int = 64, none: float = -9999.0) -> bytes:
    """A deflated file of doubles; NaN cells take the no-data value."""
    z = np.where(np.isnan(z), none, z).astype("<f8")
    strips = [zlib.compress(z[i : i + rows_a_strip].tobytes()) for i in range(0, len(z), rows_a_strip)]
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    sizes = [len(s) for s in strips]
    fields = [
        (WIDTH, "I", (z.shape[1],)), (LENGTH, "I", (len(z),)), (BITS, "H", (64,)), (PACKING, "H", (8,)), (262, "H", (1,)), (STRIP_AT, "I", tuple(np.cumsum([8, *sizes[:-1]]).tolist())),
        (SAMPLES, "H", (1,)), (STRIP_ROWS, "I", (rows_a_strip,)), (STRIP_BYTES, "I", tuple(sizes)), (FORMAT, "H", (3,)), (SCALE, "d", (cell, cell, 0.0)),
        (TIE, "d", (0.0, 0.0, 0.0, west, north, 0.0)), (GEO_KEYS, "H", keys), (NO_DATA, "s", (f"{none}\0".encode(),)),
    ]
    at = 8 + sum(sizes)
    at += at % 2
    head, more, behind = [], [], at + 2 + 12 * len(fields) + 4
    for tag, form, values in fields:
        data = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
        count, type_ = (len(data) if form == "s" else len(values)), {"H": 3, "I": 4, "d": 12, "s": 2}[form]
        if len(data) <= 4:
            place = data.ljust(4, b"\0")
        else:
            place = struct.pack("<I", behind)
            data += b"\0" * (len(data) % 2)
            more.append(data)
            behind += len(data)
        head.append(struct.pack("<HHI", tag, type_, count) + place)
    body = b"".join(strips)
    return struct.pack("<2sHI", b"II", 42, at) + body.ljust(at - 8, b"\0") + struct.pack("<H", len(fields)) + b"".join(head) + b"\0" * 4 + b"".join(more)


def write(raster: DataFrame, path: str, west: float, north: float, cell: float, epsg: int = 32632, rows_a_file: int = 512, value: str = "z") -> int:
    """Write (row, col, value) as files of ``rows_a_file`` rows each; the number of files. Each file is as wide as its cells need."""

    def run(table: pa.Table) -> pa.Table:
        band = table["band"][0].as_py()
        row, col = table["row"].to_numpy() - band * rows_a_file, table["col"].to_numpy()
        first = int(col.min())
        z = np.full((int(row.max()) + 1, int(col.max()) - first + 1), np.nan)
        z[row, col - first] = table["z"].to_numpy()
        data = encoded(z, west + first * cell, north - band * rows_a_file * cell, cell, epsg)
        return pa.table({"name": pa.array([f"band-{band:06d}.tif"]), "content": pa.array([data], pa.binary())})

    banded = raster.filter(F.col(value).isNotNull()).select(F.floor(F.col("row") / rows_a_file).cast("long").alias("band"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("z"))
    return saved(banded.groupBy("band").applyInArrow(run, "name string, content binary"), path)
