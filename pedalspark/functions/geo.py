"""Plane and sphere geometry as Column expressions: projections, WKT, polygons, lines, hexagons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563  # WGS 84
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)  # of the rectifying sphere
_K0, _EAST = 0.9996, 500_000.0
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def utm(lon: Column, lat: Column, zone: int = 32) -> tuple[Column, Column]:
    """(east, north) in metres on the northern half, by Krueger's series to the third order."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EAST + _K0 * _R * east, _K0 * _R * north


def from_utm(east: Column, north: Column, zone: int = 32) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = north / (_K0 * _R), (east - _EAST) / (_K0 * _R)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (6 * zone - 183), F.degrees(lat)


def local_factors(lat0: float) -> tuple[float, float]:
    """Metres of a degree of longitude and latitude near ``lat0``."""
    phi = math.radians(lat0)
    return 111412.84 * math.cos(phi) - 93.5 * math.cos(3 * phi), 111132.92 - 559.82 * math.cos(2 * phi) + 1.175 * math.cos(4 * phi)


def local_xy(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres from (lon0, lat0) in a plane; for towns."""
    kx, ky = local_factors(lat0)
    return (lon - lon0) * kx, (lat - lat0) * ky


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def great_circle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * 6371009.0 * F.asin(F.sqrt(a))


def bearing(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Degrees from north, 0 up to 360."""
    p0, p1, d = F.radians(lat0), F.radians(lat1), F.radians(lon1 - lon0)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p1), F.cos(p0) * F.sin(p1) - F.sin(p0) * F.cos(p1) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def wkt_points(wkt: Column) -> Column:
    """The coordinates of a WKT geometry in order, as array<struct<x, y>>."""
    pairs = F.regexp_extract_all(wkt, F.lit("(-?[0-9.]+(?:[eE][-+]?[0-9]+)?\\s+-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), 1)
    return F.transform(pairs, lambda p: F.struct(F.split(p, "\\s+")[0].cast("double").alias("x"), F.split(p, "\\s+")[1].cast("double").alias("y")))


def to_wkt_line(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))


def _sum(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + of(x))


def _steps(points: Column) -> Column:
    """Pairs of neighbours: array<struct<0: point, 1: point>>."""
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def line_length(points: Column) -> Column:
    return _sum(_steps(points), lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))


def line_centroid(points: Column) -> Column:
    """struct<x, y>: the mean of the steps' middles, weighted by length."""
    steps, total = _steps(points), line_length(points)
    weigh = lambda c: _sum(steps, lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) * (s["a"][c] + s["b"][c]) / 2)
    middle = lambda c: F.when(total > 0, weigh(c) / total).otherwise(points[0][c])
    return F.struct(middle("x").alias("x"), middle("y").alias("y"))


def polygon_area(points: Column) -> Column:
    """Of a closed ring; positive if it runs against the clock."""
    return _sum(_steps(points), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def polygon_centroid(points: Column) -> Column:
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    area = polygon_area(points)
    of = lambda c: _sum(_steps(points), lambda s: (s["a"][c] + s["b"][c]) * cross(s)) / (6 * area)
    return F.struct(of("x").alias("x"), of("y").alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring holds the point, by the parity of crossings to its right."""
    crosses = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.size(F.filter(_steps(ring), crosses)) % 2 == 1


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / square))).otherwise(0.0)
    return distance(x, y, x0 + t * dx, y0 + t * dy)


def hex_of(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-topped hexagon, of edge ``size``, that holds a point."""
    q, r = (x * (math.sqrt(3) / 3) - y / 3) / size, (y * 2 / 3) / size
    s = -q - r
    near = lambda c: F.floor(c + 0.5)
    rq, rr, rs = near(q), near(r), near(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when((dq <= dr) | (dq <= ds), F.when(dr > ds, -rq - rs).otherwise(rr)).otherwise(rr).cast("long")


def hex_centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r


def hex_disk(q: Column, r: Column, k: int) -> Column:
    """array<struct<q, r>>: the hexagons at most ``k`` steps away."""
    span = F.sequence(F.lit(-k), F.lit(k))
    cells = F.flatten(F.transform(span, lambda dq: F.transform(F.sequence(F.greatest(F.lit(-k), -dq - k), F.least(F.lit(k), -dq + k)), lambda dr: F.struct((q + dq).alias("q"), (r + dr).alias("r")))))
    return cells


def hex_ring(q: Column, r: Column, size: float) -> Column:
    """The hexagon's closed outline."""
    x, y = hex_centre(q, r, size)
    corner = lambda i: F.struct((x + size * math.cos(math.pi / 180 * (60 * i - 30))).alias("x"), (y + size * math.sin(math.pi / 180 * (60 * i - 30))).alias("y"))
    return F.array(*(corner(i % 6) for i in range(7)))
