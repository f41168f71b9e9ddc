"""Shapefiles: points, lines and polygons with their attribute table.

Shapes and attributes are two files, so each is read by itself, one file a task, and both meet by the number of the
record. The writer makes one shapefile for each partition, with its index and, as the format has it, attribute names of
at most ten characters.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import contents, saved

# Kinds of shapes, by their numbers in the format; those above 10 have further values, which are left out.
KINDS = {0: None, 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
PARTS = "array<array<struct<x:double,y:double>>>"
_NUMBERS = {"Point": 1, "LineString": 3, "Polygon": 5}
ROWS = 4096


def shapes(data: memoryview) -> Iterator[tuple[int, str | None, list[list[dict]]]]:
    """(record, kind, parts) of a .shp file, records from 0; parts are rings, lines, or one list of points."""
    at, record = 100, 0
    while at + 12 <= len(data):
        size, kind = 2 * struct.unpack_from(">i", data, at + 4)[0], struct.unpack_from("<i", data, at + 8)[0]
        body = at + 12
        name = KINDS[kind % 10]
        if name is None:
            parts = []
        elif name == "Point":
            parts = [[dict(zip("xy", struct.unpack_from("<2d", data, body)))]]
        else:
            n_parts = struct.unpack_from("<i", data, body + 32)[0] if name != "MultiPoint" else 0
            n = struct.unpack_from("<i", data, body + (36 if n_parts else 32))[0]
            cuts = [*struct.unpack_from(f"<{n_parts}i", data, body + 40), n] if n_parts else [0, n]
            xy = np.frombuffer(data, "<f8", 2 * n, body + (40 + 4 * n_parts if n_parts else 36)).reshape(-1, 2).tolist()
            parts = [[{"x": x, "y": y} for x, y in xy[i:j]] for i, j in zip(cuts, cuts[1:])]
        yield record, name, parts
        at, record = at + 8 + size, record + 1


def fields(head: bytes) -> list[tuple[str, str, int, int]]:
    """(name, Spark's kind, place in a record, width) of the columns of a .dbf file."""
    out, at, place = [], 32, 1
    while head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("latin-1")
        kind, width, decimals = chr(head[at + 11]), head[at + 16], head[at + 17]
        spark = {"N": "double" if decimals or width > 18 else "long", "F": "double", "L": "boolean", "D": "date"}.get(kind, "string")
        out.append((name, spark, place, width))
        place, at = place + width, at + 32
    return out


def read(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, record, kind, parts and the attributes) of the shapefiles below ``path``; all have the attributes of the first by name."""
    stem = F.regexp_replace("path", "\\.[a-z]+$", "")

    def shape_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            for i in range(batch.num_rows):
                held: list[tuple] = []
                for row in shapes(memoryview(batch.column(1)[i].as_buffer())):
                    held.append(row)
                    if len(held) == ROWS:
                        yield packed(batch.column(0)[i].as_py(), held, kind)
                        held = []
                yield packed(batch.column(0)[i].as_py(), held, kind)

    def packed(name: str, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind)], ["path", "record", "kind", "parts"])

    tables = contents(spark, path, ".dbf")
    first = tables.orderBy("path").select(F.substring("content", 1, 32 + 32 * 255 + 1).alias("head")).first()
    names = fields(bytes(first.head)) if first else []

    def attribute_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column(1)[i].as_buffer())
                n, start, width = struct.unpack_from("<IHH", data, 4)
                own = fields(bytes(data[:start]))
                at = {name: (place, size) for name, _, place, size in own}
                for a in range(0, n, ROWS):
                    rows = range(a, min(n, a + ROWS))
                    cell = lambda r, name: bytes(data[start + r * width + at[name][0] :][: at[name][1]]).decode(encoding, "replace").strip("\0 ") if name in at else ""  # noqa: E731, B023
                    columns = [pa.array([cell(r, name) or None for r in rows], pa.string()) for name, *_ in names]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), pa.string()), pa.array(rows, pa.int64()), *columns], ["path", "record", *(f"a{k}" for k in range(len(names)))])

    drawn = contents(spark, path, ".shp").select(stem.alias("path"), "content").mapInArrow(shape_rows, f"path string, record long, kind string, parts {PARTS}")
    if not names:
        return drawn
    texts = tables.select(stem.alias("path"), "content").mapInArrow(attribute_rows, "path string, record long" + "".join(f", a{k} string" for k in range(len(names))))

    def value(k: int, kind: str) -> F.Column:
        text = F.col(f"a{k}")
        if kind == "boolean":
            return F.when(text.isin("T", "t", "Y", "y"), True).when(text.isin("F", "f", "N", "n"), False)
        return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date") if kind == "date" else text.try_cast(kind)

    attributes = texts.select("path", "record", *(value(k, kind).alias(name) for k, (name, kind, *_) in enumerate(names)))
    return drawn.join(attributes, ["path", "record"], "left")


def short_names(columns: list[str]) -> list[str]:
    """The first ten characters of each name, told apart by numbers at their end."""
    out: list[str] = []
    for c in columns:
        name, k = c[:10], 1
        while name in out:
            name, k = f"{c[: 9 - len(str(k))]}_{k}", k + 1
        out.append(name)
    return out


def _boxed(kind: str, parts: list[list[dict]]) -> tuple[bytes, tuple[float, float, float, float]]:
    """(a record's content, its box)."""
    points = [(p["x"], p["y"]) for part in parts for p in part]
    if not points:
        return struct.pack("<i", 0), (np.inf, np.inf, -np.inf, -np.inf)
    xs, ys = zip(*points)
    box = (min(xs), min(ys), max(xs), max(ys))
    if kind == "Point":
        return struct.pack("<i2d", 1, *points[0]), box
    firsts = np.cumsum([0, *map(len, parts)])[:-1].tolist()
    return struct.pack("<i4d2i", _NUMBERS[kind], *box, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *firsts) + np.array(points, "<f8").tobytes(), box


def encoded(kind: str, drawn: list[list[list[dict]]], names: list[str], kinds: list[str], rows: list[tuple]) -> dict[str, bytes]:
    """The contents of .shp, .shx and .dbf."""
    bodies = [_boxed(kind, parts or []) for parts in drawn]
    boxes = [b for _, b in bodies] or [(0.0,) * 4]
    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    box = box if np.isfinite(box).all() else (0.0,) * 4
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, _NUMBERS[kind], *box, 0, 0, 0, 0)
    shp, shx, at = [], [], 100
    for k, (body, _) in enumerate(bodies, 1):
        shp.append(struct.pack(">2i", k, len(body) // 2) + body)
        shx.append(struct.pack(">2i", at // 2, len(body) // 2))
        at += 8 + len(body)
    text = lambda v, t: "" if v is None else ("T" if v else "F") if t == "boolean" else v.strftime("%Y%m%d") if t == "date" else repr(v) if t == "double" else str(v)
    cells = [[text(v, t).encode()[:254] for v, t in zip(row, kinds)] for row in rows]
    letters = {"double": "F", "boolean": "L", "date": "D", "long": "N"}
    widths = [{"double": 24, "boolean": 1, "date": 8, "long": 18}.get(t) or max(1, *(len(r[k]) for r in cells), 1) for k, t in enumerate(kinds)]
    width = 1 + sum(widths)
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(names), width)
    for name, t, w in zip(names, kinds, widths):
        dbf += struct.pack("<11sc4xBB14x", name.encode(), letters.get(t, "C").encode(), w, 15 if t == "double" else 0)
    dbf += b"\r" + b"".join(b" " + b"".join(c.rjust(w) if t in ("double", "long") else c.ljust(w) for c, w, t in zip(r, widths, kinds)) for r in cells) + b"\x1a"
    return {"shp": head(100 + sum(map(len, shp))) + b"".join(shp), "shx": head(100 + 8 * len(shx)) + b"".join(shx), "dbf": dbf}


def write(df: DataFrame, path: str, kind: str, parts: str = "parts") -> int:
    """Write ``df`` (parts and attributes) as shapefiles of points, lines or polygons, one for each partition; the number of files.

    Attributes are numbers, booleans, dates or texts (of at most 254 bytes); a partition must fit 2 GB, the format's limit.
    """
    columns = [c for c in df.columns if c != parts]
    simple = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "float": "double", "boolean": "boolean", "date": "date"}
    kinds = [simple.get(t, "string") for c, t in df.dtypes if c != parts]
    names = short_names(columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drawn: list = []
        rows: list[tuple] = []
        for batch in batches:
            drawn += batch.column(0).to_pylist()
            rows += list(zip(*(batch.column(k + 1).to_pylist() for k in range(len(columns))))) if columns else [()] * batch.num_rows
        if drawn:
            stem = f"part-{TaskContext.get().partitionId():05d}"
            files = encoded(kind, drawn, names, kinds, rows)
            yield pa.RecordBatch.from_pydict({"name": [f"{stem}.{x}" for x in files], "content": pa.array(files.values(), pa.binary())})

    cast = [F.col(f"`{c}`").cast(t).alias(f"c{k}") for k, (c, t) in enumerate(zip(columns, kinds))]
    return saved(df.select(F.col(parts).cast(PARTS).alias("parts"), *cast).mapInArrow(run, "name string, content binary"), path)
