from pyspark.sql import functions as F

from pedalspark.plans import report
from pedalspark.sources import readers, sinks
from pedalspark.streaming import updates


def test_csv_and_wkt(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "Via A", [(0.0, 1.5), (2.0, 3.0)], "m9", 2)], "u long, v long, name string, geometry array<struct<x:double,y:double>>, rule string, lts int")
    sinks.edges_csv(df, f"{tmp_path}/e")
    back = readers.csv_with_wkt(spark, f"{tmp_path}/e").first()
    assert [(p.x, p.y) for p in back.geometry] == [(0.0, 1.5), (2.0, 3.0)] and back.rule == "m9"
    (tmp_path / "b.wkt").write_text("POLYGON ((1 2, 3 4, 5 6, 1 2))")
    assert len(readers.wkt_boundary(spark, f"{tmp_path}/b.wkt").first().ring) == 4


def test_graphml(spark, tmp_path):
    (tmp_path / "g.xml").write_text("""<?xml version='1.0'?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d1" for="node" attr.name="x" attr.type="string"/><key id="d9" for="edge" attr.name="name" attr.type="string"/>
<graph edgedefault="directed"><node id="5"><data key="d1">11.3</data></node><node id="6"/><edge source="5" target="6" id="0"><data key="d9">['Via A', 'Via B']</data></edge></graph></graphml>""")
    nodes, edges = readers.graphml(spark, f"{tmp_path}/g.xml")
    assert {r.node: dict(r.tags or {}) for r in nodes.collect()} == {5: {"x": "11.3"}, 6: {}}
    e = edges.withColumn("names", readers.listed_names(F.col("tags")["name"])).first()
    assert (e.u, e.v, e.names) == (5, 6, ["Via A", "Via B"])
    df = spark.createDataFrame([(5, 6, "3.0", None)], "u long, v long, lanes string, name string")
    sinks.graphml(spark.createDataFrame([(5, 1.5)], "node long, x double"), df, f"{tmp_path}/out")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/out/edges").collect())
    assert 'source="5"' in text and ">3<" in text and "name" not in text
    nodes, edges = readers.graphml(spark, f"{tmp_path}/out")
    assert [(r.node, dict(r.tags)) for r in nodes.collect()] == [(5, {"x": "1.5"})]
    assert [(r.u, r.v, dict(r.tags)) for r in edges.collect()] == [(5, 6, {"lanes": "3"})]


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"k","anno":2019.0,"DTINCID":"2019-05-01T00:00:00Z"},"geometry":{"type":"Point","coordinates":[11.3,46.5]}},{"type":"Feature","properties":{"id":"l","anno":null,"DTINCID":null},"geometry":{"type":"Point","coordinates":[11.4,46.6]}}]}')
    rows = readers.accidents_geojson(spark, f"{tmp_path}/a.geojson").orderBy("id").collect()
    assert tuple(rows[0]) == ("k", 2019, "2019-05-01", 11.3, 46.5) and rows[1].anno is None
    (tmp_path / "l.geojson").write_text('{"features":[{"properties":{"n":"1"},"geometry":{"type":"LineString","coordinates":[[1,2],[3.5,-4e0]]}}]}')
    line = readers.geojson(spark, f"{tmp_path}/l.geojson", "n:string").first()
    assert line.kind == "LineString" and [(p.x, p.y) for p in line.points] == [(1.0, 2.0), (3.5, -4.0)]
    df = spark.createDataFrame([("1", [(1.0, 2.0), (3.0, 4.0)])], "n string, line array<struct<x:double,y:double>>")
    sinks.geojson(df, f"{tmp_path}/g", "line", "LineString", ["n"])
    assert spark.read.json(f"{tmp_path}/g").first().geometry.coordinates == [[1.0, 2.0], [3.0, 4.0]]
    back = readers.geojson(spark, f"{tmp_path}/g", "n:string", lines=True).first()
    assert (back.n, back.kind) == ("1", "LineString") and [(p.x, p.y) for p in back.points] == [(1.0, 2.0), (3.0, 4.0)]


def test_json_keys_and_names(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"(1, 22)": [1, 5, 22], "(3, 4)": [3, 4]}')
    assert {(r.source, r.target): list(r.path) for r in readers.keyed_paths(spark, f"{tmp_path}/p.json").collect()} == {(1, 22): [1, 5, 22], (3, 4): [3, 4]}
    sinks.keyed_json(spark.createDataFrame([(1, 22, 5.0)], "source long, target long, d double"), f"{tmp_path}/k")
    assert spark.read.text(f"{tmp_path}/k").first().value == '{"(1, 22)":5.0}'
    sinks.keyed_json(spark.createDataFrame([(1, 22, [1, 5, 22]), (3, 4, [3, 4])], "source long, target long, path array<long>"), f"{tmp_path}/kp")
    assert {(r.source, r.target): list(r.path) for r in readers.keyed_paths(spark, f"{tmp_path}/kp", lines=True).collect()} == {(1, 22): [1, 5, 22], (3, 4): [3, 4]}
    df = spark.createDataFrame([("<osm><relation><tag k='name' v='X'/><tag k='population' v='107317'/></relation></osm>",), ("<osm/>",)], "d string")
    assert [r.p for r in df.select(readers.population_of(F.col("d")).alias("p")).collect()] == [107317, None]
    f = spark.createDataFrame([('A/B "x"', "school", None, 1.0, 2.0), ("c", None, "bar", 1.0, 2.0)], "name string, amenity string, leisure string, lon double, lat double")
    assert {(r.name, r.type) for r in readers.points_of_interest(f, {"amenity": ["school"], "leisure": ["bar"]}).collect()} == {("A_B x", "school"), ("c", "bar")}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("residential", "m9"), ("track", "m15")], "highway string, expected string")
    rows.write.parquet(f"{tmp_path}/in")
    out = updates.stress_updates(spark, f"{tmp_path}/in", "highway string, expected string")
    updates.write_updates(out, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert {(r.rule, r.expected) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("m9", "m9"), ("m15", "m15")}
    spark.sql("SELECT timestamp'2024-01-01 05:00:00' AS ts, 'a' AS kind UNION ALL SELECT timestamp'2024-01-01 06:00:00', 'a' UNION ALL SELECT timestamp'2024-01-09 00:00:00', 'b'").write.parquet(f"{tmp_path}/ev")
    counts = updates.accident_counts(spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/ev"))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.kind, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_report(spark):
    t = spark.createDataFrame([(1, "a")], "lts int, name string")
    text = report.markdown("Bolzano", {"Gap Analysis": {"Gaps": t}}, accidents=False)
    assert "| 1 | a |" in text and "Accident" not in text
    assert "Section 8: Sum-Up Analysis" in report.markdown("Trento", {}, accidents=True)


def test_rasters_and_centroids(spark, tmp_path):
    dem = spark.range(2000).select((F.col("id") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"), F.col("id").cast("double").alias("z"))
    sinks.raster_parquet(dem, f"{tmp_path}/r", rows_a_band=100)
    assert sorted(map(tuple, readers.raster_parquet(spark, f"{tmp_path}/r").collect())) == sorted(map(tuple, dem.collect()))
    some = readers.raster_parquet(spark, f"{tmp_path}/r", (150, 160), 100)
    assert {r.row for r in some.collect()} == set(range(150, 161)) and "PartitionFilters: [" in some._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)],)], "points array<struct<x:double,y:double>>")
    assert tuple(readers.centroids(df).select("lon", "lat").first()) == (2.0, 1.0)
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)],), ([(0.0, 0.0), (8.0, 0.0), (8.0, 2.0)],), ([(5.0, 6.0)],)], "points array<struct<x:double,y:double>>")
    assert [tuple(r) for r in readers.centroids(df).select("lon", "lat").collect()] == [(2.0, 1.0), (4.8, 0.2), (5.0, 6.0)]  # many corners on one side, a line, a point
