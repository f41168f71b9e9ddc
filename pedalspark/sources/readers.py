"""Readers of the formats in which street data comes. All paths go through Spark, so any store that it reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import line_centroid, polygon_area, polygon_centroid, wkt_points


def csv_with_wkt(spark: SparkSession, path: str, schema: str | None = None, geometry: str = "geometry") -> DataFrame:
    """A CSV table with a header whose ``geometry`` becomes array<struct<x, y>>."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.withColumn(geometry, wkt_points(F.col(geometry)))


def wkt_boundary(spark: SparkSession, path: str) -> DataFrame:
    """(ring): the outline in a WKT text file."""
    return spark.read.text(path, wholetext=True).select(wkt_points(F.col("value")).alias("ring"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a map ``tags`` of named attributes, all text; absent attributes are absent from the map.

    ``path`` is a file or a folder with files at any depth, as the sink writes them. Attributes without a key keep their id.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).schema(schema).load(path)
    data = "data array<struct<_VALUE:string,_key:string>>"
    keys = read("key", "_id string, `_attr.name` string, _for string")
    names = keys.select(F.struct("_id", "`_attr.name`").alias("e"))
    names = names.agg(F.map_from_entries(F.collect_list("e")).alias("names")).withColumn("one", F.lit(1))  # the file's few attribute names
    tags = F.map_from_entries(F.transform(F.filter("data", lambda d: d["_VALUE"].isNotNull()), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]), d["_VALUE"])))
    named = lambda df: df.withColumn("one", F.lit(1)).join(F.broadcast(names), "one")
    nodes = named(read("node", f"_id long, {data}")).select(F.col("_id").alias("node"), tags.alias("tags"))
    edges = named(read("edge", f"_source long, _target long, _id int, {data}")).select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce("_id", F.lit(0)).alias("key"), tags.alias("tags"))
    return nodes, edges


def listed_names(text: Column) -> Column:
    """"['Via A', 'Via B']" or "Via A" -> array of names."""
    return F.when(text.isNotNull(), F.split(F.regexp_replace(text, "[\\[\\]']", ""), ", "))


def geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """(properties, kind, points): features with their coordinates flattened to array<struct<x, y>>, whatever the nesting.

    ``lines``: files with a feature a line, as the sink writes them, instead of whole collections.
    """
    feature = f"struct<properties:struct<{properties}>,geometry:string>"
    if lines:
        features = spark.read.schema(f"properties struct<{properties}>, geometry string").json(path).select(F.struct("properties", "geometry").alias("f"))
    else:
        features = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    numbers = F.regexp_extract_all(F.get_json_object("f.geometry", "$.coordinates"), F.lit("\\[\\s*(-?[0-9.eE+-]+\\s*,\\s*-?[0-9.eE+-]+)[^\\[\\]]*\\]"), 1)
    points = F.transform(numbers, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.trim(F.split(p, ",")[1]).cast("double").alias("y")))
    return features.select("f.properties.*", F.get_json_object("f.geometry", "$.type").alias("kind"), points.alias("points"))


def accidents_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, anno, DTINCID, lon, lat): dates lose the suffix of their time."""
    df = geojson(spark, path, "id:string,anno:double,DTINCID:string")
    return df.select("id", F.col("anno").cast("int").alias("anno"), day(F.col("DTINCID")).alias("DTINCID"), F.col("points")[0]["x"].alias("lon"), F.col("points")[0]["y"].alias("lat"))


def day(stamp: Column) -> Column:
    return F.regexp_replace(stamp, "T.*$", "")


def layers_named(layers: DataFrame, part: str = "ciden") -> DataFrame:
    return layers.filter(F.col("name").contains(part))


def population_of(xml: Column) -> Column:
    """The first population tag of a map document, or null."""
    return F.xpath_string(xml, F.lit("(//tag[@k='population']/@v)[1]")).try_cast("long")


def pair_key(text: Column) -> Column:
    """"(12, 34)" -> struct<source, target>."""
    part = lambda i: F.regexp_extract(text, "\\((-?\\d+),\\s*(-?\\d+)\\)", i).try_cast("long")
    return F.struct(part(1).alias("source"), part(2).alias("target"))


def keyed_paths(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(source, target, path) of a JSON object whose keys are texts of pairs; ``lines``: of an object a line, as the sink writes them."""
    text = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,array<long>>").alias("m"))
    return text.select(F.explode("m").alias("k", "path")).select(pair_key(F.col("k")).alias("k"), "path").select("k.*", "path")


def points_of_interest(features: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(name, type, lon, lat) of features (name, lon, lat and a column for each tag) by tag values; a feature with several tags comes for each."""
    out = None
    for tag, values in wanted.items():
        one = features.filter(F.col(tag).isin(values)).select(clean_name(F.col("name")).alias("name"), F.col(tag).alias("type"), "lon", "lat")
        out = one if out is None else out.unionByName(one)
    return out


def clean_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("/"), F.lit("_")), F.lit('"'), F.lit(""))


def raster_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, z) of a raster exported in long form."""
    return spark.read.schema("row int, col int, z double").option("header", True).csv(path)


def raster_parquet(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, rows_a_band: int = 512) -> DataFrame:
    """(row, col, value) of a raster in bands, or of the rows from ``rows[0]`` up to ``rows[1]``."""
    df = spark.read.parquet(path)
    if rows:
        df = df.filter(F.col("band").between(rows[0] // rows_a_band, rows[1] // rows_a_band) & F.col("row").between(*rows))
    return df.drop("band")


def centroids(features: DataFrame, points: str = "points") -> DataFrame:
    """``features`` with lon and lat of their centroid: that of the area of a closed ring, of a line's length, or the point itself."""
    p = F.col(points)
    ring = (F.size(p) > 3) & (p[0] == F.element_at(p, -1)) & (F.abs(polygon_area(p)) > 0)
    middle = F.when(ring, polygon_centroid(p)).otherwise(line_centroid(p))
    return features.withColumns({"lon": middle["x"], "lat": middle["y"]})
