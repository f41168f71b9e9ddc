"""Rules of stress, one row for each code, and the recorded cases."""

import pytest
from pyspark.sql import functions as F

from pedalspark.functions.tags import EDGE_TAGS
from pedalspark.operators import lts, terrain

SCHEMA = ", ".join(f"`{c}` {t}" for c, t in {**EDGE_TAGS, "cycleway": "string", "cycleway:left": "string", "parking:both": "string", "slope": "double"}.items())
COLUMNS = [*EDGE_TAGS, "cycleway", "cycleway:left", "parking:both", "slope"]


def edges(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], SCHEMA)


CASES = [
    ("p2", dict(highway="residential", bicycle="no")),
    ("p6", dict(highway="residential", access="no")),
    ("p3", dict(highway="motorway")),
    ("p4", dict(highway="motorway_link")),
    ("p7", dict(highway="proposed")),
    ("p5", dict(highway="footway", footway="sidewalk")),
    ("s3", dict(highway="cycleway")),
    ("s1", dict(highway="path")),
    ("s2", dict(highway="footway")),
    ("s7", dict(highway="primary", **{"cycleway:left": "track"})),
    ("s8", dict(highway="primary", cycleway="opposite_track")),
    ("b1", dict(highway="residential", cycleway="lane", width=5.0, maxspeed="30", lanes="2")),
    ("b2", dict(highway="primary", cycleway="lane", lanes="3", maxspeed="50")),
    ("b3", dict(highway="residential", cycleway="lane", width=4.1, **{"parking:both": "parallel"})),
    ("b4", dict(highway="residential", cycleway="lane", est_width=4.2)),
    ("b5", dict(highway="residential", cycleway="lane", width=4.5, maxspeed="40")),
    ("b6", dict(highway="residential", cycleway="lane", width=6.0, maxspeed="50")),
    ("b7", dict(highway="residential", cycleway="lane", width=6.0, maxspeed="55")),
    ("b8", dict(highway="residential", cycleway="lane", width=6.0, maxspeed="70")),
    ("b9", dict(highway="tertiary", cycleway="lane", width=6.0, maxspeed="30")),
    ("m17", dict(highway="residential", motor_vehicle="no")),
    ("m13", dict(highway="pedestrian")),
    ("m14", dict(highway="footway", footway="crossing")),
    ("m2", dict(highway="service", service="alley")),
    ("m15", dict(highway="track")),
    ("m3", dict(highway="service", service="parking_aisle")),
    ("m4", dict(highway="service", service="driveway")),
    ("m16", dict(highway="service", maxspeed="30")),
    ("m5", dict(highway="residential", maxspeed="40", lanes="3")),
    ("m6", dict(highway="tertiary", maxspeed="40", lanes="3")),
    ("m7", dict(highway="residential", maxspeed="40", lanes="5")),
    ("m8", dict(highway="residential", maxspeed="40", lanes="6")),
    ("m9", dict(highway="residential")),
    ("m10", dict(highway="residential", lanes="3")),
    ("m11", dict(highway="residential", lanes="4")),
    ("m12", dict(highway="primary")),
]


def test_every_rule(spark):
    got = lts.edge_stress(edges(spark, *(r for _, r in CASES)).withColumn("i", F.monotonically_increasing_id())).orderBy("i").collect()
    assert [r.rule for r in got] == [c for c, _ in CASES]
    assert all(r.base_lts == lts.STRESS[r.rule] and r.message == lts.MESSAGES[r.rule] and r.short_message == lts.SHORT_MESSAGES[r.rule] for r in got)
    assert set(lts.STRESS) == {c for c, _ in CASES}


def test_missing_columns_and_lists(spark):
    df = spark.createDataFrame([("residential", ["2", "4"], ["30", "IT:urban"], True), ("residential", None, ["fast"], False)], "highway string, lanes array<string>, maxspeed array<string>, oneway boolean")
    a, b = lts.classify(df).collect()
    assert (a.lanes_assumed, a.maxspeed_assumed, a.width_assumed) == (1, 50, 2.5)
    assert (b.lanes_assumed, b.maxspeed_assumed) == (2, 50)
    by_class = lts.classify(edges(spark, *(dict(highway=h) for h in ("motorway", "primary", "secondary", "tertiary")))).collect()
    assert [(r.maxspeed_assumed, r.width_assumed) for r in by_class] == [(130, 11.25), (90, 7.0), (90, 6.0), (50, 5.0)]


@pytest.mark.parametrize(
    "row, expected",
    [
        (dict(highway="track", length=78.953, slope=10.1177, context="urban"), 4),
        (dict(highway="proposed", slope=12.0, context="urban"), 2),
        (dict(highway="track", slope=9.0, context="countryside"), 3),
        (dict(highway="track", slope=6.0, context="urban"), None),
        (dict(highway="track", slope=6.0, context="urban", length=500.0), 3),
        (dict(highway="track", slope=6.0, context="urban", length=499.0), 2),
        (dict(highway="track", slope=2.0, context="urban"), 2),
        (dict(highway="primary", slope=25.0, context="countryside", length=900.0), 4),
    ],
)
def test_slope_penalty(spark, row, expected):
    assert lts.edge_stress(edges(spark, row)).first().lts == expected


def test_slope_penalty_flags(spark):
    row = edges(spark, dict(highway="proposed", slope=12.0, context="urban"))
    assert lts.edge_stress(row, protect_not_allowed=True).first().lts == 0
    row = edges(spark, dict(highway="track", slope=6.0, context="urban", length=100.0))
    assert lts.edge_stress(row, legacy=True).first().lts == 3


def test_slope_class(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 3.0, 19.99, 20.0, -1.0, None)], "s double").select(lts.slope_class(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == ["0-3: flat", "3-5: mild", "10-20: extreme", ">20: impossible", None, None]
    ends = spark.createDataFrame([(100.0, 110.0), (0.0, 200.0)], "a double, b double").select(terrain.endpoint_slope(F.col("a"), F.col("b"), F.lit(200.0)).alias("s"))
    assert [r.s for r in ends.collect()] == [5.0, 0.0]


def test_junctions(spark):
    e = spark.createDataFrame([(1, 9, 4), (2, 9, 4), (3, 9, 4), (4, 9, 2), (5, 9, 2), (5, 8, 1)], "u long, v long, lts int")
    n = spark.createDataFrame([(1, "traffic_signals"), (2, "stop"), (3, None), (4, "stop"), (5, None), (9, None)], "node long, highway string")
    got = {r.node: (r.lts, r.message) for r in lts.node_stress(n, e).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 9)] == [2, 4, 4, 1, 2, None]
    assert got[9][1] == "Node not found in edges" and got[1][1] == "LTS 3-4 with traffic signals"


def test_names(spark):
    df = spark.createDataFrame([("Bolzano - Bozen, Italy", "Tangenziale Est", 2), ("San Vito, Italy", "Pista ciclabile Autostrada", 3), ("X", None, 0)], "place string, name string, lts int")
    got = df.select(lts.city_name(F.col("place")).alias("c"), lts.display_class(F.col("name"), F.col("lts")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("Bolzano", "not cyclable"), ("San_Vito", "3"), ("X", "undefined")]


def test_columns_nobody_asks_for_are_pruned(spark):
    """Ends of streets come without the rules; a filter on stress doesn't repeat them below its projection."""
    from pedalspark.plans.queries_streets import stressed

    df = stressed(spark, "/root/testdata/sf0.001")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    ends = plan(df.select("u", "v").distinct())
    assert "Generate" not in ends and "rand(" not in ends and "highway" not in ends
    assert plan(df.filter("lts > 2").select("u", "rule")).count("CASE WHEN") < 2 * plan(df.select("u", "rule", "lts")).count("CASE WHEN")
