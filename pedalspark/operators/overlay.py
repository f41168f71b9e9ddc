"""Polygons with polygons: which meet, how much they share, and sums over hexagons, in Column expressions.

Rings are closed arrays of struct<x, y>. Polygons meet through the grid cells of their bounding boxes; a pair is looked at
in the one cell that holds the lower left corner of what the boxes share, so no pair comes twice and nothing is made
distinct afterwards. Hexagons under a polygon are listed from its box and need no join at all; what they share is summed over
the polygon's steps, a batch of rows at a time. Rectangles along the axes meet and share as their boxes do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _steps, contains, hex_centre, hex_ring, polygon_area
from .lts import fenced

_POINTS = "array<struct<x:double,y:double>>"


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _half(points: Column, a: Column, b: Column) -> Column:
    """The open ring ``points`` cut to the left of the line from ``a`` to ``b`` (Sutherland and Hodgman, 1974)."""

    def at(p: Column, i: Column) -> Column:
        before = F.element_at(points, F.when(i == 0, F.size(points)).otherwise(i))
        here, there = _cross(a, b, p), _cross(a, b, before)
        t = there / (there - here)
        met = F.struct((before["x"] + t * (p["x"] - before["x"])).alias("x"), (before["y"] + t * (p["y"] - before["y"])).alias("y"))
        own = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        none = F.array().cast(_POINTS)
        return F.when(here >= 0, F.when(there >= 0, F.array(own)).otherwise(F.array(met, own))).otherwise(F.when((there >= 0), F.array(met)).otherwise(none))

    return F.flatten(F.transform(points, at))


def clipped(ring: Column, convex: Column) -> Column:
    """``ring`` cut by a convex ring that runs against the clock, closed; an empty array if they share nothing."""
    start = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).cast(_POINTS)
    cut = F.aggregate(_steps(convex), start, lambda points, s: _half(points, s["a"], s["b"]))
    return _once(cut, lambda c: F.when(F.size(c) > 2, F.concat(c, F.slice(c, 1, 1))).otherwise(F.array().cast(_POINTS)))


def _fan(ring: Column) -> Column:
    """array<struct<ring, sign>>: triangles from the first corner, against the clock, whose signed sum is the polygon."""
    first = ring[0]

    def triangle(s: Column) -> Column:
        back = _cross(first, s["a"], s["b"]) < 0
        corners = F.array(first, F.when(back, s["b"]).otherwise(s["a"]), F.when(back, s["a"]).otherwise(s["b"]), first)
        return F.struct(corners.alias("ring"), F.when(back, -1.0).otherwise(1.0).alias("sign"))

    return F.transform(F.filter(_steps(ring), lambda s: _cross(first, s["a"], s["b"]) != 0), triangle)


def _upright(ring: Column) -> Column:
    """Whether a ring is a rectangle along the axes, so that it is its own bounding box."""
    same = lambda c, i, j: F.get(ring, F.lit(i))[c] == F.get(ring, F.lit(j))[c]
    turns = lambda c, d: same(c, 0, 1) & same(d, 1, 2) & same(c, 2, 3) & same(d, 3, 0)
    return F.coalesce((F.size(ring) == 5) & same("x", 0, 4) & same("y", 0, 4) & (turns("x", "y") | turns("y", "x")), F.lit(False))


def shared_area(a: Column, b: Column) -> Column:
    """The area that two simple polygons share, convex or not, however their rings run."""
    of = lambda ring, c, best: best(F.get(ring, F.lit(0))[c], F.get(ring, F.lit(2))[c])
    ends = lambda c: F.least(of(a, c, F.greatest), of(b, c, F.greatest)) - F.greatest(of(a, c, F.least), of(b, c, F.least))
    boxes = F.greatest(F.lit(0.0), ends("x")) * F.greatest(F.lit(0.0), ends("y"))
    return F.when(_upright(a) & _upright(b), boxes).otherwise(_shared_by_fans(a, b))


def _shared_by_fans(a: Column, b: Column) -> Column:
    total = lambda x, y: F.aggregate(_fan(x), F.lit(0.0), lambda acc, t: acc + F.aggregate(_fan(y), F.lit(0.0), lambda more, u: more + t["sign"] * u["sign"] * polygon_area(clipped(t["ring"], u["ring"]))))
    return F.abs(_once(F.struct(a.cast(_POINTS).alias("a"), b.cast(_POINTS).alias("b")), lambda p: total(p["a"], p["b"])))


def _meets(s: Column, t: Column) -> Column:
    """Whether two steps have a point in common."""
    d1, d2 = _cross(s["a"], s["b"], t["a"]), _cross(s["a"], s["b"], t["b"])
    d3, d4 = _cross(t["a"], t["b"], s["a"]), _cross(t["a"], t["b"], s["b"])
    apart = lambda c: (F.greatest(s["a"][c], s["b"][c]) < F.least(t["a"][c], t["b"][c])) | (F.greatest(t["a"][c], t["b"][c]) < F.least(s["a"][c], s["b"][c]))
    return ((d1 <= 0) & (d2 >= 0) | (d1 >= 0) & (d2 <= 0)) & ((d3 <= 0) & (d4 >= 0) | (d3 >= 0) & (d4 <= 0)) & ~apart("x") & ~apart("y")


def meet(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common: steps that meet, or one inside the other."""
    both = F.struct(a.cast(_POINTS).alias("a"), b.cast(_POINTS).alias("b"))

    def test(p: Column) -> Column:
        steps = F.exists(_steps(p["a"]), lambda s: F.exists(_steps(p["b"]), lambda t: _meets(s, t)))
        return steps | contains(p["a"], p["b"][0]["x"], p["b"][0]["y"]) | contains(p["b"], p["a"][0]["x"], p["a"][0]["y"])

    return _once(both, test)


def boxed(polygons: DataFrame, ring: str = "ring", prefix: str = "") -> DataFrame:
    """``polygons`` with x0, y0, x1, y1 of their bounding boxes, named with ``prefix``."""
    of = lambda c, best: best(F.transform(F.col(ring), lambda p: p[c]))
    return polygons.withColumns({f"{prefix}x0": of("x", F.array_min), f"{prefix}y0": of("y", F.array_min), f"{prefix}x1": of("x", F.array_max), f"{prefix}y1": of("y", F.array_max)})


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _dealt(polygons: DataFrame, *by: str) -> DataFrame:
    """``polygons`` over all tasks: few bytes may hold many, and each is much work."""
    return polygons.repartition(_tasks(polygons), *by)


def _of_kind(polygons: DataFrame, ring: str, name: str) -> DataFrame:
    """``polygons`` with whether they are rectangles along the axes, for filters that don't make rings anew."""
    return polygons.withColumn(name, fenced(_upright(F.col(ring))))


#: Polygons of the right that a task meets at once in one cell; fuller cells are split.
CELL = 4096


def _in_cells(polygons: DataFrame, ring: str, side: str, cell: float) -> DataFrame:
    """``polygons`` with their boxes, whether they are rectangles (``side`` u), and a row for each cell _i, _j of the box.

    ``side`` i and ``side`` j tell the box's first column and row.
    """
    at = lambda c: F.floor(F.col(f"{side}{c}") / cell)
    rows = boxed(_of_kind(_dealt(polygons), ring, f"{side}u"), ring, side)
    rows = rows.withColumn("_i", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_j", F.explode(F.sequence(at("y0"), at("y1"))))
    return rows.withColumns({f"{side}i": F.col("_i") == at("x0"), f"{side}j": F.col("_j") == at("y0")})


def _boxes_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows in cells whose boxes meet, each in the one cell of the lower left corner of what they share.

    Only a list of the fullest cells, a row for ``CELL`` of the right at most, is broadcast. Tasks are as many as the session
    names: few bytes make many pairs.
    """
    full = F.broadcast(b.groupBy("_i", "_j").agg(F.ceil(F.count("*") / CELL).cast("int").alias("_n")).filter("_n > 1"))
    parts = F.coalesce("_n", F.lit(1))
    a = a.join(full, ["_i", "_j"], "left").withColumn("_s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    b = b.join(full, ["_i", "_j"], "left").withColumn("_s", F.pmod(F.xxhash64(*b.columns), parts).cast("int")).drop("_n")
    cell = ["_i", "_j", "_s"]
    pairs = a.repartition(_tasks(a), *cell).join(b.repartition(_tasks(a), *cell).hint("merge"), cell).drop(*cell)
    return pairs.filter("_ax0 <= _bx1 AND _bx0 <= _ax1 AND _ay0 <= _by1 AND _by0 <= _ay1 AND (_ai OR _bi) AND (_aj OR _bj)")


_OF_BOXES = tuple(f"_{s}{c}" for s in "ab" for c in ("x0", "y0", "x1", "y1", "u", "i", "j"))


def overlapping(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """The pairs of ``left`` (..., ring) and ``right`` (..., other_ring) that have a point in common, each once.

    ``cell``: the grid's width, about that of a polygon; larger polygons stand in several cells. No other columns of both
    sides may share a name.
    """
    pairs = _boxes_meet(_in_cells(left, "ring", "_a", cell), _in_cells(right, "other_ring", "_b", cell))
    return pairs.filter(F.when(F.col("_au") & F.col("_bu"), True).otherwise(meet(F.col("ring"), F.col("other_ring")))).drop(*_OF_BOXES)


def overlaps(left: DataFrame, right: DataFrame, cell: float, only: Column | None = None) -> DataFrame:
    """Pairs as ``overlapping`` finds them, without rings, with the ``area`` that they share; ``only`` chooses among pairs.

    Rectangles along the axes meet by their boxes and leave their rings behind; pairs with other polygons go apart, so that
    the many tests of rectangles stay short.
    """
    a, b = _in_cells(left, "ring", "_a", cell).filter("_au").drop("ring"), _in_cells(right, "other_ring", "_b", cell).filter("_bu").drop("other_ring")
    long = lambda c: F.least(f"_a{c}1", f"_b{c}1") - F.greatest(f"_a{c}0", f"_b{c}0")
    chosen = lambda pairs: pairs if only is None else pairs.filter(only)
    found = chosen(_boxes_meet(a, b)).withColumn("area", long("x") * long("y")).drop(*_OF_BOXES)
    of_kind, other = _of_kind(left, "ring", "_u"), _of_kind(right, "other_ring", "_u")
    odd, other_odd = of_kind.filter("NOT _u").drop("_u"), other.filter("NOT _u").drop("_u")
    for one, two, any_ in ((odd, right, odd), (of_kind.filter("_u").drop("_u"), other_odd, other_odd)):
        if not any_.isEmpty():
            shared = shared_area(F.col("ring"), F.col("other_ring"))
            found = found.unionByName(chosen(overlapping(one, two, cell)).withColumn("area", shared).drop("ring", "other_ring"))
    return found


def _hexagon_area(size: float):
    """area(ring, x, y): what a ring shares with the hexagon of edge ``size`` around (x, y).

    At each height a polygon's part within [-h, h] is the sum of its crossings, bounded by -h and h, signed by the steps'
    directions. So the area is a sum over steps of integrals that are linear between the places where a step meets one
    of the hexagon's lines. What is below the sum's rounding counts as nothing.
    """
    root = math.sqrt(3)

    @F.arrow_udf("double")
    def area(ring: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        offsets, points = ring.offsets.to_numpy(), ring.values
        px, py = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
        cx, cy = (c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
        steps = np.maximum(np.diff(offsets) - 1, 0)
        ends, total, fine = np.cumsum(steps), np.zeros(len(steps)), np.zeros(len(steps))
        for first in range(0, int(ends[-1]) if len(ends) else 0, 1 << 15):
            k = np.arange(first, min(first + (1 << 15), int(ends[-1])))
            row = np.searchsorted(ends, k, "right")
            at = offsets[row] + k - (ends[row] - steps[row])
            ax, ay = px[at] - cx[row], py[at] - cy[row]
            dx, dy = px[at + 1] - cx[row] - ax, py[at + 1] - cy[row] - ay
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                cuts = [(h - ay) / dy for h in (-size, -size / 2, size / 2, size)] + [(c * root / 2 * size - ax) / dx for c in (-1, 1)]
                cuts += [(c * root * (size - d * ay) - ax) / (dx + d * c * root * dy) for c in (-1, 1) for d in (-1, 1)]
            t = np.stack([np.zeros(len(k)), np.ones(len(k)), *cuts])
            t = np.sort(np.clip(np.where(np.isnan(t), 0, t), 0, 1), 0)
            half = np.clip(root * (size - np.abs(ay + dy * t)), 0, root / 2 * size)
            within = np.clip(ax + dx * t, -half, half)
            total += np.bincount(row, dy * (np.diff(t, axis=0) * (within[1:] + within[:-1])).sum(0) / 2, len(steps))
            fine += np.bincount(row, np.abs(dy), len(steps))
        total = np.abs(total)
        return pa.array(np.where(total > 1e-13 * size * fine, total, 0.0))

    return area


def hexagons_under(polygons: DataFrame, size: float, key: list[str], touching: bool = True) -> DataFrame:
    """(key, q, r, area, share): the hexagons of edge ``size`` that a polygon has a point in common with.

    ``area`` is what they share and ``share`` its part of the polygon; both are 0 where they only touch, and without
    ``touching`` those are left out.
    """
    tall, wide = 1.5 * size, math.sqrt(3) * size
    rows = boxed(_dealt(polygons.select(*key, "ring"), *key)).withColumn("_whole", F.abs(polygon_area(F.col("ring"))))
    rows = rows.withColumn("r", F.explode(F.sequence(F.floor((F.col("y0") - size) / tall), F.ceil((F.col("y1") + size) / tall))))
    shift = F.col("r") / 2 * wide
    cells = rows.withColumn("q", F.explode(F.sequence(F.floor((F.col("x0") - shift) / wide - 0.5), F.ceil((F.col("x1") - shift) / wide + 0.5))))
    x, y = hex_centre(F.col("q"), F.col("r"), size)
    near = (x + wide / 2 >= F.col("x0")) & (x - wide / 2 <= F.col("x1")) & (y + size >= F.col("y0")) & (y - size <= F.col("y1"))
    cells = cells.filter(near).withColumn("area", _hexagon_area(size)(F.col("ring").cast(_POINTS), x, y))
    own = F.col("area") > 0
    cells = cells.filter(F.when(own, True).otherwise(meet(F.col("ring"), hex_ring(F.col("q"), F.col("r"), size))) if touching else own)
    return cells.select(*key, F.col("q").cast("long").alias("q"), F.col("r").cast("long").alias("r"), "area", F.when(F.col("_whole") > 0, F.col("area") / F.col("_whole")).otherwise(0.0).alias("share"))


def hex_totals(polygons: DataFrame, size: float, value: str, by_area: bool = False, key: list[str] | None = None) -> DataFrame:
    """(q, r, value): sums of a column of ``polygons`` (id, ring, value) over the hexagons that they meet: whole, or by their share of area."""
    key = key or ["id"]
    cells = hexagons_under(polygons.select(*key, "ring", value), size, [*key, value], touching=not by_area)
    amount = F.col(value) * F.col("share") if by_area else F.col(value)
    return cells.filter("share > 0" if by_area else "true").groupBy("q", "r").agg(F.sum(amount).alias(value))
