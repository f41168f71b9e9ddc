"""Writers. Each makes a folder of part files, as Spark's writers do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import to_wkt_line

# Columns of the street table that is handed on.
EDGE_COLUMNS = ["u", "v", "key", "osmid", "lanes", "name", "highway", "maxspeed", "geometry", "length", "rule", "lts", "slope", "slope_class", "lanes_assumed", "maxspeed_assumed", "message", "short_message"]


def edges_csv(edges: DataFrame, path: str) -> None:
    """The columns above that ``edges`` has, geometry as WKT, arrays as texts."""
    kinds = dict(edges.dtypes)

    def text(c: str) -> Column:
        if kinds[c].startswith("array<struct"):
            return to_wkt_line(F.col(c)).alias(c)
        return F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if kinds[c].startswith("array") else F.col(c)

    edges.select(*(text(c) for c in EDGE_COLUMNS if c in kinds)).write.option("header", True).csv(path)


def whole_text(value: Column) -> Column:
    """Numbers such as "3.0" as whole numbers."""
    return F.regexp_replace(value.cast("string"), "^(-?\\d+)\\.0$", "$1")


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Folders ``keys``, ``nodes`` and ``edges`` of XML, which the reader takes together; a missing attribute is absent."""

    def data(df: DataFrame, ids: list[str]) -> Column:
        rest = [c for c in df.columns if c not in ids]
        pairs = F.array(*(F.struct(F.lit(c).alias("_key"), whole_text(F.col(f"`{c}`")).alias("_VALUE")) for c in rest))
        return F.filter(pairs, lambda p: p["_VALUE"].isNotNull() & (p["_VALUE"] != "NaN")).alias("data")

    out = lambda df, tag: df.write.format("xml").option("rootTag", "graph").option("rowTag", tag).save(f"{path}/{tag}s")
    named = [(c, kind, c, "string") for df, kind, ids in ((nodes, "node", ["node"]), (edges, "edge", ["u", "v"])) for c in df.columns if c not in ids]
    out(nodes.sparkSession.createDataFrame(named, "`_id` string, `_for` string, `_attr.name` string, `_attr.type` string").coalesce(1), "key")
    out(nodes.select(F.col("node").alias("_id"), data(nodes, ["node"])), "node")
    out(edges.select(F.col("u").alias("_source"), F.col("v").alias("_target"), data(edges, ["u", "v"])), "edge")


def feature(geometry: Column, kind: str, properties: list[str]) -> Column:
    """A GeoJSON feature as text; ``geometry`` is array<struct<x, y>>, or struct<x, y> for points."""
    pair = lambda p: F.array(p["x"], p["y"])
    coordinates = pair(geometry) if kind == "Point" else F.transform(geometry, pair)
    if kind == "Polygon":
        coordinates = F.array(coordinates)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def geojson(df: DataFrame, path: str, geometry: str, kind: str, properties: list[str]) -> None:
    """One feature a line."""
    df.select(feature(F.col(geometry), kind, properties).alias("value")).write.text(path)


def keyed_json(df: DataFrame, path: str) -> None:
    """(source, target, ...): an object a line, from the pair as text to the one further column, or to an object of them."""
    rest = [c for c in df.columns if c not in ("source", "target")]
    value = F.col(rest[0]) if len(rest) == 1 else F.struct(*rest)
    key = F.concat(F.lit("("), F.col("source"), F.lit(", "), F.col("target"), F.lit(")"))
    df.select(F.to_json(F.create_map(key, value)).alias("value")).write.text(path)


def hexagon_table(df: DataFrame, path: str) -> None:
    """Full column names, as Parquet."""
    df.write.parquet(path)


def text_dump(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def raster_parquet(raster: DataFrame, path: str, value: str = "z", rows_a_band: int = 512) -> None:
    """A raster in long form (row, col, value), in bands of rows, so that a reader of a region skips the others."""
    band = F.floor(F.col("row") / rows_a_band)
    raster.select("row", "col", value, band.alias("band")).repartitionByRange("band", "row").sortWithinPartitions("row", "col").write.partitionBy("band").parquet(path)
