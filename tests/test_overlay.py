"""Polygons with polygons against strips and points counted in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pedalspark.functions import geo
from pedalspark.operators import overlay

RING = "array<struct<x:double,y:double>>"


def star(rng, corners, reach=50.0):
    """A simple polygon, seldom convex, that runs either way."""
    cx, cy = rng.uniform(-80, 80), rng.uniform(-80, 80)
    angles = [(k + rng.uniform(0, 0.4)) * 2 * math.pi / corners for k in range(corners)]  # no gap of half a turn
    ring = [(cx + (r := rng.uniform(0.2, 1) * reach) * math.cos(a), cy + r * math.sin(a)) for a in angles]
    ring = ring if rng.random() < 0.5 else ring[::-1]
    return ring + ring[:1]


def crossings(ring, y):
    return sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:]) if (a[1] > y) != (b[1] > y))


def shared(a, b):
    """Area by strips: between two neighbouring heights of corners or crossings all widths are linear, so the middle is exact."""
    cuts = {p[1] for p in a + b}
    for p, q in zip(a, a[1:]):
        for r, s in zip(b, b[1:]):
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
                if 0 <= t <= 1:
                    cuts.add(p[1] + t * (q[1] - p[1]))
    total, heights = 0.0, sorted(cuts)
    for lo, hi in zip(heights, heights[1:]):
        x, y = crossings(a, (lo + hi) / 2), crossings(b, (lo + hi) / 2)
        total += (hi - lo) * sum(max(0.0, min(x[i + 1], y[j + 1]) - max(x[i], y[j])) for i in range(0, len(x), 2) for j in range(0, len(y), 2))
    return total


def test_shared_areas_of_any_polygons(spark):
    rng = random.Random(7)
    left, right = [star(rng, rng.choice([3, 4, 7, 11])) for _ in range(14)], [star(rng, rng.choice([3, 5, 9])) for _ in range(14)]
    a, b = spark.createDataFrame(list(enumerate(left)), f"id long, ring {RING}"), spark.createDataFrame(list(enumerate(right)), f"other long, other_ring {RING}")
    expected = {(i, j): area for i, x in enumerate(left) for j, y in enumerate(right) if (area := shared(x, y)) > 1e-9}
    for cell in (15.0, 1000.0):  # a polygon in many cells, and in one
        rows = overlay.overlapping(a, b, cell).select("id", "other", overlay.shared_area(F.col("ring"), F.col("other_ring")).alias("area")).collect()
        assert len({(r.id, r.other) for r in rows}) == len(rows)
        assert {(r.id, r.other): pytest.approx(r.area, abs=1e-6) for r in rows} == expected


def test_touching_holding_and_missing(spark):
    square = lambda x, y, w: [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]
    a = spark.createDataFrame([(0, square(0, 0, 10))], f"id long, ring {RING}")
    others = [square(10, 0, 5), square(2, 2, 3), square(-20, -20, 100), square(10.001, 0, 5), square(10, 10, 1), square(0, 0, 10)]
    b = spark.createDataFrame(list(enumerate(others)), f"other long, other_ring {RING}")
    got = overlay.overlapping(a, b, 7.0).select("other", overlay.shared_area(F.col("ring"), F.col("other_ring")).alias("area")).collect()
    assert {r.other: r.area for r in got} == {0: 0.0, 1: pytest.approx(9), 2: pytest.approx(100), 4: 0.0, 5: pytest.approx(100)}
    assert overlay.overlapping(a, b.limit(0), 7.0).count() == 0


def test_hexagons_share_a_polygon_out(spark):
    rng, size = random.Random(9), 11.0
    rings = [star(rng, n) for n in (3, 6, 12)]
    df = spark.createDataFrame([(i, r, 10.0 * (i + 1)) for i, r in enumerate(rings)], f"id long, ring {RING}, people double")
    cells = overlay.hexagons_under(df, size, ["id"]).collect()
    for i, ring in enumerate(rings):
        mine = {(c.q, c.r): c for c in cells if c.id == i}
        assert sum(c.share for c in mine.values()) == pytest.approx(1)
        for q in range(-15, 16):
            for r in range(-15, 16):
                x, y = size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
                hexagon = [(x + size * math.cos(math.radians(60 * k - 30)), y + size * math.sin(math.radians(60 * k - 30))) for k in (0, 1, 2, 3, 4, 5, 0)]
                area = shared(ring, hexagon)
                assert area < 1e-9 or mine[q, r].area == pytest.approx(area, abs=1e-6)
    by_area = overlay.hex_totals(df, size, "people", by_area=True)
    assert by_area.agg(F.sum("people")).first()[0] == pytest.approx(60)
    whole = {(r.q, r.r): r.people for r in overlay.hex_totals(df, size, "people").collect()}
    assert whole == {k: pytest.approx(sum(10.0 * (c.id + 1) for c in cells if (c.q, c.r) == k)) for k in {(c.q, c.r) for c in cells}}


def test_clip_keeps_what_is_inside(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0), (-5.0, -5.0)])], f"ring {RING}, box {RING}")
    row = df.select(overlay.clipped(F.col("ring"), F.col("box")).alias("c"), geo.polygon_area(overlay.clipped(F.col("box"), F.col("box"))).alias("a")).first()
    assert {(p.x, p.y) for p in row.c} == {(0, 0), (1, 0), (1, 1)} and row.a == 100


def test_cells_that_a_segment_crosses(spark):
    """Against points close together along the segment; every corner that it clips is there."""
    from pedalspark.operators import terrain

    rng = random.Random(5)
    rows = [(i, *(rng.uniform(-40, 40) for _ in range(4))) for i in range(40)] + [(90, 5.0, 5.0, 5.0, 5.0), (91, 3.0, -12.0, 3.0, 31.0), (92, 20.0, 1.0, -20.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    got = df.select("id", terrain.crossed_cells(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), 10.0).alias("cells")).collect()
    for (i, x0, y0, x1, y1), cells in zip(rows, (r.cells for r in sorted(got, key=lambda r: r.id))):
        length = math.hypot(x1 - x0, y1 - y0)
        assert sum(c.length for c in cells) == pytest.approx(length) and len({(c.row, c.col) for c in cells}) == len(cells)
        seen = {(math.floor((y0 + (y1 - y0) * k / 4000) / 10), math.floor((x0 + (x1 - x0) * k / 4000) / 10)) for k in range(1, 4000)}
        assert seen <= {(c.row, c.col) for c in cells} | {(c.row, c.col) for c in cells if c.length < 0.1}, i
        assert all(c.length < 0.1 or (c.row, c.col) in seen for c in cells) or length == 0


def test_hexagons_share_many_polygons_out_by_sums_over_steps(spark):
    """Areas without a clip for each pair, as large inputs need them: against clips, for polygons in batches of any size."""
    rng, size = random.Random(21), 13.0
    rings = [star(rng, rng.choice([3, 5, 9, 40])) for _ in range(12)] + [[(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    df = spark.createDataFrame(list(enumerate(rings)), f"id long, ring {RING}")
    got = overlay.hexagons_under(df, size, ["id"], touching=False)
    assert "arrow" in got._jdf.queryExecution().optimizedPlan().toString().lower()
    clip = F.abs(geo.polygon_area(overlay.clipped(F.col("ring"), geo.hex_ring(F.col("q"), F.col("r"), size))))
    rows = got.join(df, "id").select("id", "q", "r", "area", "share", clip.alias("clip")).collect()
    assert all(r.area > 0 and r.area == pytest.approx(r.clip, abs=1e-8) for r in rows)
    for i in range(len(rings)):
        assert sum(r.share for r in rows if r.id == i) == pytest.approx(1)


def test_rectangles_share_what_their_boxes_share(spark):
    """As exactly as the boxes' own differences; other rings of five corners go the general way."""
    rect = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    a = [rect(0.1, 0.2, 10.7, 5.3), rect(3.3, 1.1, 0.7, 0.9)[::-1], [(0.0, 0.0), (6.0, 1.0), (7.0, 6.0), (1.0, 5.0), (0.0, 0.0)]]
    df = spark.createDataFrame(list(enumerate(a)), f"id long, ring {RING}")
    pairs = overlay.overlapping(df, df.select(F.col("id").alias("other"), F.col("ring").alias("other_ring")), 4.0)
    upright = pairs.select("id", "other", overlay._upright(F.col("ring")).alias("u"), overlay.shared_area(F.col("ring"), F.col("other_ring")).alias("area")).collect()
    got = {(r.id, r.other): r.area for r in upright}
    assert len(got) == 9 and {r.id: r.u for r in upright} == {0: True, 1: True, 2: False}
    assert got[0, 1] == (3.3 + 0.7 - 3.3) * (1.1 + 0.9 - 1.1) and got[2, 2] == pytest.approx(shared(a[2], a[2])) and got[0, 2] == pytest.approx(shared(a[0], a[2]))


def test_overlaps_of_full_cells_meet_by_boxes(spark, monkeypatch):
    """Rectangles by their boxes alone, cells split in parts, no side broadcast; other polygons as ever, each pair once."""
    rng = random.Random(31)
    rect = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    rings = [rect(rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(1, 20), rng.uniform(1, 20)) for _ in range(40)]
    rings += [[(x * 0.3 + 10, y * 0.3 + 10) for x, y in star(rng, n)] for n in (3, 5, 8)] + rings[:3]
    df = spark.createDataFrame(list(enumerate(rings)), f"id long, ring {RING}")
    other = df.select(F.col("id").alias("other"), F.col("ring").alias("other_ring"))
    monkeypatch.setattr(overlay, "CELL", 3)
    only = F.col("id") < F.col("other")
    rows = overlay.overlaps(df, other, 9.0, only).collect()
    got = {(r.id, r.other): r.area for r in rows}
    assert len(got) == len(rows)
    assert {k: pytest.approx(a, abs=1e-6) for k, a in got.items() if a > 1e-9} == {(i, j): a for i, x in enumerate(rings) for j, y in enumerate(rings) if i < j and (a := shared(x, y)) > 1e-9}
    plan = overlay.overlaps(df.filter("id < 40"), other.filter("other < 40"), 9.0, only)._jdf.queryExecution()
    assert "SortMergeJoin [_i" in plan.executedPlan().toString()
    join = plan.optimizedPlan().toString().split("Join Inner")[1]
    assert "RepartitionByExpression" in join and "ring" not in join.split("RepartitionByExpression")[0]
    assert overlay.overlaps(df.limit(0), other, 9.0).count() == 0


def test_full_cells_are_dealt_over_tasks(spark, monkeypatch):
    """2,000 copies of one square: no task holds more of a side than a part of the cell, and all pairs are there."""
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))))
    monkeypatch.setattr(overlay, "CELL", 50)
    df = spark.range(2000).select("id", square.alias("ring"))
    pairs = overlay.overlaps(df, df.select(F.col("id").alias("other"), F.col("ring").alias("other_ring")), 10.0)
    assert pairs.groupBy(F.spark_partition_id()).count().count() > 1
    assert pairs.agg(F.count("*"), F.sum("area")).first()[:] == (4_000_000, 4_000_000.0)
