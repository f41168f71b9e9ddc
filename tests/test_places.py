"""Spatial, statistical and clustering operators against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalspark.functions import geo, stats
from pedalspark.operators import access, accidents, autocorrelation, clusters, clusters_hierarchical, risk, spatial, terrain
from pedalspark.plans import registry


def cloud(seed, n, span=100.0):
    rng = random.Random(seed)
    return [(i, round(rng.random() * span, 1), round(rng.random() * span, 1)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def other(df):
    return df.select(F.col("id").alias("oid"), F.col("x").alias("rx"), F.col("y").alias("ry"))


def test_radius_and_nearest(spark):
    a, b = cloud(1, 80), cloud(2, 60)
    got = {(r.id, r.oid) for r in spatial.within(frame(spark, a), other(frame(spark, b)), 9.0).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 9}
    near = spatial.nearest(frame(spark, a), other(frame(spark, b)), "id", "oid", 3).collect()
    expected = {(i, k + 1): j for i, x, y in a for k, (_, j) in enumerate(sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in b)[:3])}
    assert {(r.id, r["rank"]): r.oid for r in near} == expected
    assert spatial.nearest(frame(spark, a), other(frame(spark, b[:2])), "id", "oid", 5).count() == 160
    assert spatial.nearest(frame(spark, a).limit(0), other(frame(spark, b)), "id", "oid").count() == 0


def test_segments(spark):
    rng, pts = random.Random(3), cloud(3, 150)
    seg = [(k, *(round(rng.random() * 100, 1) for _ in range(4))) for k in range(25)] + [(90, 5.0, 5.0, 5.0, 80.0), (91, 50.0, 50.0, 50.0, 50.0)]
    df = spark.createDataFrame(seg, "k long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.id, r.k) for r in spatial.near_segments(frame(spark, pts), df, 4.0, ["id", "k"]).collect()}

    def far(x, y, x0, y0, x1, y1):
        q = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = max(0, min(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / q)) if q else 0
        return math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0))

    assert got == {(i, k) for i, x, y in pts for k, *s in seg if far(x, y, *s) <= 4}


def test_geometry(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", "LINESTRING (0 0, 3 4, 3 10)")], "p string, l string").select(geo.wkt_points(F.col("p")).alias("p"), geo.wkt_points(F.col("l")).alias("l"))
    r = df.select(geo.polygon_area(F.col("p")).alias("a"), geo.polygon_centroid(F.col("p")).alias("c"), geo.line_length(F.col("l")).alias("n"), geo.line_centroid(F.col("l")).alias("m"), geo.contains(F.col("p"), F.lit(1.0), F.lit(1.0)).alias("i"), geo.contains(F.col("p"), F.lit(5.0), F.lit(1.0)).alias("o"), geo.to_wkt_line(F.col("l")).alias("w")).first()
    assert (r.a, r.c.x, r.c.y, r.n, r.i, r.o) == (8.0, 2.0, 1.0, 11.0, True, False)
    assert (r.m.x, r.m.y) == (pytest.approx((5 * 1.5 + 6 * 3) / 11), pytest.approx((5 * 2 + 6 * 7) / 11)) and r.w.startswith("LINESTRING (0.0 0.0, 3.0 4.0")
    east, north = geo.utm(F.lit(11.35), F.lit(46.5))
    at = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert abs(at.e - 680_300) < 400 and abs(at.n - 5_152_500) < 800
    lon, lat = geo.from_utm(F.lit(at.e), F.lit(at.n))
    back = spark.range(1).select(lon.alias("x"), lat.alias("y")).first()
    assert abs(back.x - 11.35) < 1e-8 and abs(back.y - 46.5) < 1e-8
    b = spark.range(1).select(geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"), geo.great_circle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d")).first()
    assert b.b == pytest.approx(90) and b.d == pytest.approx(111_195, abs=5)


def test_hexagons(spark):
    pts = frame(spark, cloud(4, 300, 1000.0))
    rows = spatial.with_hex(pts, 50.0).select("x", "y", *(c.alias(n) for c, n in zip(geo.hex_centre(F.col("q"), F.col("r"), 50.0), ("cx", "cy"))), geo.contains(geo.hex_ring(F.col("q"), F.col("r"), 50.0), F.col("x"), F.col("y")).alias("inside")).collect()
    assert all(math.hypot(r.x - r.cx, r.y - r.cy) <= 50.001 for r in rows) and sum(r.inside for r in rows) >= len(rows) - 1
    disk = spark.range(1).select(F.explode(geo.hex_disk(F.lit(0), F.lit(0), 3)).alias("h")).collect()
    assert len(disk) == 37
    cells = spatial.hexagons(pts, 50.0)
    empty = access.hex_sums(pts, cells, 50.0).agg(F.min("n"), F.count("*")).first()
    assert empty[0] == 0 and access.hex_sums(pts, cells, 50.0, count_empty=True).agg(F.min("n")).first()[0] == 1


def test_kernel_density(spark):
    rows = [(i, x, y) for i, x, y in cloud(5, 200)]
    got = {(r.i, r.j): r.density for r in spatial.kernel_density(frame(spark, rows), 10.0, 20.0).collect()}
    true = sum(math.exp(-((40 - x) ** 2 + (60 - y) ** 2) / 200) / (200 * math.pi) for _, x, y in rows if math.hypot(40 - x, 60 - y) <= 30)
    assert got[2, 3] == pytest.approx(true, rel=0.05)


def test_terrain(spark):
    dem = spark.createDataFrame([(r, c, 3.0 * c + 4.0 * r) for r in range(6) for c in range(6)], "row int, col int, z double")
    assert {round(x.slope, 9) for x in terrain.slopes(dem, 100.0).collect()} == {5.0} and terrain.slopes(dem, 100.0).count() == 16
    assert terrain.slopes(dem, 100.0, tangent_of_ratio=True).first().slope == pytest.approx(math.tan(0.05) * 100)
    e = spark.createDataFrame([(1, 150.0, 150.0, 350.0, 150.0), (2, 9000.0, 0.0, 9100.0, 0.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: (r.slope, r.slope_class) for r in terrain.edge_slopes(e, terrain.slopes(dem, 100.0), 100.0, "id").collect()}
    assert got[1] == (pytest.approx(5.0), "5-8: medium") and got[2] == (None, None)
    tiles = spark.createDataFrame([(2, 0, 0, 9.0), (1, 0, 0, None), (1, 0, 1, 5.0), (2, 0, 1, 7.0)], "tile int, row int, col int, z double")
    assert {(r.row, r.col): r.z for r in terrain.mosaic(tiles).collect()} == {(0, 0): 9.0, (0, 1): 5.0}
    q = terrain.quintiles(spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "distance double")).first()
    assert q.p60 == pytest.approx(2.6)
    houses = frame(spark, [(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 100.0, 0.0)])
    near = {r.id: r.context for r in terrain.context_by_quintile(frame(spark, [(1, 1.0, 1.0), (2, 500.0, 0.0)]), houses).collect()}
    assert near == {1: "urban", 2: "countryside"}


def test_scores(spark):
    types = [t for _, _, ts in access.TAXONOMY for t, *_ in ts]
    all_ = spark.createDataFrame([("full", t) for t in types for _ in range(3)] + [("schools", "school")] * 5, "hex string, type string")
    cells = spark.createDataFrame([("full",), ("schools",), ("none",)], "hex string")
    totals = access.total_scores(access.type_scores(all_, cells))
    assert {r.hex: pytest.approx(r.total_score) for r in totals.collect()} == {"full": access.MAXIMUM, "schools": 8.4, "none": 0.0}
    people = spark.createDataFrame([("full", 1), ("schools", 3), ("none", 0)], "hex string, population long")
    assert access.overall_score(totals, people).first()[0] == pytest.approx((77.8 + 3 * 8.4) / 4)
    base, low = (spark.createDataFrame(r, "a string, b string, distance double") for r in ([("x", "y", 10.0), ("x", "z", 10.0), ("y", "z", 4.0)], [("x", "y", 15.0), ("x", "z", 15.1), ("q", "z", 1.0)]))
    assert {(r.a, r.b): r.connected for r in access.connected(base, low).collect()} == {("x", "y"): True, ("x", "z"): False, ("y", "z"): False, ("q", "z"): True}


def test_statistics(spark):
    assert stats.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and stats.chi2_p(30.0, 10) == pytest.approx(0.000857, abs=1e-5)
    assert stats.t_p(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    w, p = stats.shapiro_wilk([148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.002)
    df = spark.createDataFrame([("['2', '3']",), ("none",), ("IT:urban;30",), ("50|70",)], "t string")
    got = df.select(stats.clean_lanes(F.col("t")).alias("l"), stats.clean_speed(F.col("t")).alias("s"), stats.mean_of_numbers(F.col("t")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("2 or 3", 3, 2.5), ("none", 50, None), ("30", 50, 30.0), ("50 or 70", 70, 60.0)]
    near = accidents.near_nodes(frame(spark, [(1, 0.0, 0.0), (2, 50.0, 0.0)]), spark.createDataFrame([(7, 3.0, 4.0), (8, 4.0, 3.0)], "node long, x double, y double"), 5.0)
    assert {(r.id, r.node) for r in near.collect()} == {(1, 7), (1, 8), (2, None)}


def brute_dbscan(rows, eps, least):
    near = {i: [j for j, u, v in rows if math.hypot(x - u, y - v) <= eps] for i, x, y in rows}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in core:
        if i not in label:
            stack, label[i] = [i], i
            while stack:
                for j in near[stack.pop()]:
                    if j in core and j not in label:
                        label[j] = i
                        stack.append(j)
    place = {i: (x, y) for i, x, y in rows}
    out = {}
    for i, x, y in rows:
        best = i if i in core else min((j for j in near[i] if j in core), key=lambda j: ((x - place[j][0]) ** 2 + (y - place[j][1]) ** 2, place[j]), default=None)
        out[i] = (label.get(best), i in core)
    return out


@pytest.mark.parametrize("eps, least", [(6.0, 4), (15.0, 8), (3.0, 2)])
def test_dbscan(spark, eps, least):
    rows = cloud(6, 250) + [(1000 + i, 50.0, 50.0) for i in range(40)]
    got, true = {r.id: (r.cluster, r.core) for r in clusters.dbscan(frame(spark, rows), eps, least).collect()}, brute_dbscan(rows, eps, least)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in true.items()}
    pairs = {(got[i][0], true[i][0]) for i in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all((a == -1) == (b is None) for a, b in pairs)


def test_hierarchical_clusters():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (3, 6))] + [rng.uniform(-3, 9, (12, 2))])
    for labels in (clusters_hierarchical.hdbscan_labels(x), clusters_hierarchical.optics_labels(x, 10)):
        groups = [set(labels[k * 60 : k * 60 + 60]) - {-1} for k in range(3)]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3, labels


def test_moran(spark):
    lines = spark.createDataFrame([(i, [(float(i), 0.0), (float(i + 1), 0.0)]) for i in range(6)], "id long, line array<struct<x:double,y:double>>")
    w = autocorrelation.touching(lines)
    assert w.count() == 10
    values = spark.createDataFrame([(i, n) for i, n in enumerate((9, 8, 9, 1, 2, 1))], "id long, n long")
    y = np.array([9, 8, 9, 1, 2, 1], float)
    z = y - y.mean()
    lag = np.array([np.mean([z[j] for j in (i - 1, i + 1) if 0 <= j < 6]) for i in range(6)])
    assert autocorrelation.global_moran(values, w).first().moran_i == pytest.approx((z * lag).sum() / (z * z).sum())
    local = autocorrelation.local_moran(values, w)
    rows = {r.id: r for r in local.collect()}
    assert [rows[i].quadrant for i in range(6)] == [1 if a > 0 and b > 0 else 2 if a <= 0 and b > 0 else 3 if a <= 0 else 4 for a, b in zip(z, lag)]
    assert all(rows[i].local_i == pytest.approx(5 * z[i] * lag[i] / (z * z).sum()) for i in range(6))
    p = {r.id: r.p_sim for r in autocorrelation.significance(local, w, 199).collect()}
    assert all(0 < v <= 0.5025 for v in p.values())
    counts = autocorrelation.counts_on_lines(spark.createDataFrame([(1, 0.2, 1.0), (2, 0.4, 3.0), (3, 5.5, -40.0)], "pid long, x double, y double"), lines, 0.5)
    assert {r.id: r.n for r in counts.collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    marks = spark.createDataFrame([("g", 1), ("g", 3), ("h", None)], "gap string, quadrant int")
    assert {r.gap: r.quadrant for r in autocorrelation.quadrant_mode(marks).collect()} == {"g": 1, "h": None}


def test_risk(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(2 * (i % 5 == 0), 1), rng.gauss(0, 1), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    for kind in ("smote", "borderline", "adasyn"):
        counts = {r.label: r.n for r in risk.smote(df, ["a", "b"], "id", kind=kind).groupBy("label").agg(F.count("*").alias("n")).collect()}
        assert counts[0] == 240 and abs(counts[1] - 240) <= 40, kind
    assert risk.smote(df, ["a", "b"], "id", kind="smoteenn").count() < 480
    train, test = risk.split(df, "id")
    assert train.count() + test.count() == 300 and 30 <= test.count() <= 90
    scaled, every = risk.standardised(train, df, features=["a", "b"])
    scored = risk.with_score(risk.forest(scaled, trees=10).transform(every))
    assert risk.areas(scored)["roc_auc"] > 0.8
    r = {x["class"]: x for x in risk.report(scored).collect()}
    assert r[0].support == 240 and r[1].support == 60
    roc = risk.roc_points(scored).orderBy("threshold").first()
    assert (roc.tpr, roc.fpr) == (1.0, 1.0)
    weights = {x.label: x.weight for x in risk.class_weights(df).collect()}
    assert weights == {0: pytest.approx(0.625), 1: pytest.approx(2.5)}


def test_queries_run_the_whole_job(spark, monkeypatch):
    from pedalspark.operators import autocorrelation, risk, spatial
    from pedalspark.plans import queries_network, queries_places

    sf = "/root/testdata/sf0.001"
    cells = spatial.hexagons(queries_places.points(spark, sf, "population"), queries_places.HEX).select("q", "r").distinct().count()
    assert queries_network._rep(spark, sf).select("hex").distinct().count() == cells

    class Called(Exception):
        pass

    def called(*args, **kwargs):
        raise Called(kwargs)

    monkeypatch.setattr(queries_places, "_line_counts", lambda *_: (spark.range(1), spark.range(1)))
    monkeypatch.setattr(autocorrelation, "local_moran", lambda *_: spark.range(1))
    monkeypatch.setattr(autocorrelation, "significance", called)
    for query in (queries_places.moran_pvalues, queries_places.component_summary):
        with pytest.raises(Called) as e:
            query(spark, sf)
        assert e.value.args[0].get("permutations", 999) == 999
    monkeypatch.setattr(risk, "forest", called)
    with pytest.raises(Called) as e:
        queries_places.risk_rf_predict(spark, sf)
    assert e.value.args[0].get("trees", 100) == 100


@pytest.mark.parametrize("k, exclude", [(1, True), (2, True), (3, False)])
def test_nearest_among_copies_clusters_and_far_points(spark, k, exclude):
    """Places with many copies cost no pairs; points far from all others are found too."""
    rng = random.Random(k)
    rows = [(i, float(rng.choice([0, 1, 2])), float(rng.choice([0, 1]))) for i in range(200)]
    rows += [(i, 50 + rng.random(), 50 + rng.random()) for i in range(200, 260)] + [(260, 9000.0, -4000.0), (261, 9000.0, -4000.5), (262, -7e5, 3.0)]
    rows += [(i, float(i % 23), 200.0 + i // 23) for i in range(270, 400)]  # ties
    near = spatial.nearest(frame(spark, rows), other(frame(spark, rows)), "id", "oid", k, exclude_equal_ids=exclude).collect()
    expected = {}
    for i, x, y in rows:
        for r, (d, j) in enumerate(sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in rows if j != i or not exclude)[:k]):
            expected[i, r + 1] = (j, d)
    assert {(r.id, r["rank"]): (r.oid, r.distance) for r in near} == expected


def test_nearest_makes_no_pairs_of_copies(spark, monkeypatch):
    """Each of 3,000 points at three places has its neighbour at no distance: nothing is joined in cells."""
    rows = spark.range(3000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    asked = []
    monkeypatch.setattr(spatial, "_cell", lambda *a: asked.append(a) or F.lit(0))
    got = spatial.nearest(rows, other(rows), "id", "oid", 2, exclude_equal_ids=True).groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    assert not asked and got.filter("n = 2 AND d = 0").count() == 3000


def test_context_where_most_buildings_share_a_place(spark):
    """A radius of 0 still finds the streets that stand on a building, as the SQL does."""
    houses = frame(spark, [(i, float(i // 4), 0.0) for i in range(40)])
    got = {r.id: r.context for r in terrain.context_by_quintile(frame(spark, [(1, 3.0, 0.0), (2, 3.5, 0.0)]), houses).collect()}
    assert got == {1: "urban", 2: "countryside"}


def test_context_copies_streets_and_not_buildings(spark):
    """Each place of a building is joined once, whatever the number of streets."""
    plan = terrain.context(frame(spark, [(1, 3.0, 0.0)]), spark.range(50).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), 30.0)._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.index("Generate explode"):].splitlines()
    assert not any("Range" in line for line in generate[:3])


def test_neighbour_searches_join_no_pairs(spark, monkeypatch):
    """Distinct places are compared within their cells: no table of the search joins places or sorts pairs of them."""
    plans, keep = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name))
    houses = spark.range(3000).select("id", (F.col("id") % 50 + F.rand(1) / 4).alias("x"), (F.floor(F.col("id") / 50) + F.rand(2) / 4).alias("y"))
    assert terrain.building_distances(houses).filter("distance > 0").count() == 3000
    first = [plan for name, plan in plans if name == "nearest"][0]
    assert "Join" not in first and first.count("Aggregate") == 1


def _shuffled(spark, f):
    """Bytes that shuffles wrote while ``f`` ran, without broadcasts, and what it returned."""
    sc, held = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        return f(), written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("name, rows", [("context_quintiles", 1), ("building_nn_distance", None)])
def test_queries_on_buildings_shuffle_few_bytes_of_each(spark, tmp_path, name, rows):
    """A building is sent as its place and to the cells it lies close to: not to nine cells, nor with each of its neighbours, as large tables once were."""
    n = 20_000
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 15_000).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got, sent = _shuffled(spark, lambda: registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert len(got) == (rows or n) and sent < 120 * n


@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_in_parts_of_cells_and_at_full_places(spark, monkeypatch, k):
    """Crowded tiles, cells in parts, strips of pairs, places fuller than what they keep and rows without a place give the true neighbours."""
    for name, value in {"TILE": 16, "PAIRS": 64, "HELD": 4}.items():
        monkeypatch.setattr(spatial, name, value)
    rng = random.Random(k)
    rows = [(i, 7.0 + rng.random() / 100, rng.random() / 100) for i in range(120)] + [(i, rng.random() * 900, rng.random() * 900) for i in range(120, 200)]
    rows += [(i, 5.0, 5.0) for i in range(200, 209)] + [(i, 6.0, 5.0) for i in range(209, 212)] + [(212, -9000.0, 3.0)]
    df = frame(spark, rows).unionByName(spark.createDataFrame([(300, None, 1.0), (None, 5.0, 5.0)], "id long, x double, y double"))
    got = {(r.id, r["rank"]): (r.other, r.distance) for r in spatial.nearest_others(df, "id", k).collect()}
    expected = {}
    for i, x, y in rows:
        for r, (d, j) in enumerate(sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in rows if j != i)[:k]):
            expected[i, r + 1] = (j, d)
    assert got == expected


def test_context_tells_apart_only_buildings_near_streets(spark, monkeypatch):
    """Places of buildings are told apart after those far from all streets are left out."""
    asked, keep = [], terrain.within
    monkeypatch.setattr(terrain, "within", lambda places, *a: asked.append(places.count()) or keep(places, *a))
    houses = spark.range(2000).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = {r.id: r.context for r in terrain.context(frame(spark, [(1, 40.0, 9.0), (2, 40.0, 11.0)]), houses, 10.0).collect()}
    assert got == {1: "urban", 2: "countryside"} and asked == [30]


def test_accidents_meet_streets_without_a_row_for_each_pair(spark):
    """2,000,000 accidents and as many streets on two pieces: 2e12 meetings, counted and not made."""
    n = 2_000_000
    found = spark.range(n).select("id", (F.col("id") % 2).alias("piece"))
    streets = spark.range(n).select((F.col("id") % 2).alias("piece"), F.when(F.col("id") % 4 < 2, "2;4").otherwise("1").alias("lanes"))
    got = {r.lanes: r.accident_count for r in accidents.by_lanes(accidents.meetings(found, streets, ["piece"], ["lanes"]), "n").collect()}
    assert got == {"2 or 4": n * n // 4, "1": n * n // 4}


def test_silhouette_of_blocks_holds_a_strip_at_a_time(spark, monkeypatch):
    """No task may hold all distances of two blocks: strips of 64 give the mean that whole rows do."""
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(90, 2)), rng.integers(0, 4, 90)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = np.stack([d[:, c == k].sum(1) / np.where(c == k, (c == k).sum() - 1, (c == k).sum()) for k in range(4)], 1)
    a = means[np.arange(90), c]
    means[np.arange(90), c] = np.inf
    expected = ((means.min(1) - a) / np.maximum(a, means.min(1))).mean()
    df = spark.createDataFrame([(float(p), float(q), int(k)) for (p, q), k in zip(x, c)], "a double, b double, cluster long")
    monkeypatch.setattr(clusters, "STRIP", 64)
    assert clusters.silhouette(df, ["a", "b"]).first()[0] == pytest.approx(expected, abs=1e-9)


def test_silhouette_far_from_the_origin_in_few_blocks(spark):
    """Rows close together and far from 0 keep their distances, and a row is not sent once for each 4,096 others."""
    rng = np.random.default_rng(6)
    x, c = 1e8 + rng.integers(0, 40, (90, 2)) / 8, rng.integers(0, 3, 90)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = np.stack([d[:, c == k].sum(1) / np.where(c == k, (c == k).sum() - 1, (c == k).sum()) for k in range(3)], 1)
    a = means[np.arange(90), c]
    means[np.arange(90), c] = np.inf
    expected = ((means.min(1) - a) / np.maximum(a, means.min(1))).mean()
    df = spark.createDataFrame([(float(p), float(q), int(k)) for (p, q), k in zip(x, c)], "a double, b double, cluster long")
    assert clusters.silhouette(df, ["a", "b"]).first()[0] == pytest.approx(expected, abs=1e-9)
    many = spark.range(20_000).select(F.col("id").cast("double").alias("a"), F.lit(0.0).alias("b"), (F.col("id") % 2).alias("cluster"))
    plan = clusters.silhouette(many, ["a", "b"])._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 2" in plan and "sequence(0, 4" not in plan
