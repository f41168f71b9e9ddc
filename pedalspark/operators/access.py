"""Destination access on a hexagonal grid, and the score of a bicycle network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import by_stress
from .paths import distances
from .spatial import nearest, with_hex

# Category, its weight, and (type, weight, curve).
TAXONOMY = [
    ("Opportunity", 40, [("school", 30, "A"), ("library", 15, "B"), ("kindergarten", 25, "A"), ("university", 30, "A")]),
    ("Core services", 30, [("doctors", 20, "D"), ("dentist", 10, "D"), ("hospital", 30, "C"), ("pharmacy", 10, "D"), ("supermarket", 30, "E")]),
    ("Retail", 20, [("retail", 20, "D"), ("shop", 20, "D"), ("mall", 20, "D")]),
    ("Transit", 15, [("train_station", 40, "G"), ("bus_station", 30, "G"), ("bus_stop", 30, "G")]),
    ("Recreation", 15, [("park", 25, "B"), ("fitness_centre", 25, "B"), ("sports_centre", 15, "B"), ("restaurant", 15, "B"), ("bar", 10, "C"), ("cafe", 10, "C")]),
]
# Points of the first, second and third destination on each curve.
CURVES = {"A": [30, 20, 20], "B": [40, 20, 10], "C": [70], "D": [40, 20, 10], "E": [60, 20], "F": [70, 20], "G": [60]}
# The largest score that the two tables above allow.
MAXIMUM = 77.8
RADIUS, DETOUR = 2000.0, 1.5


def taxonomy(spark: SparkSession) -> DataFrame:
    """(type, category, type_weight, category_weight, points): ``points[n]`` is what n destinations earn."""
    rows = [(t, c, w, cw, [sum(CURVES[k][:n]) for n in range(len(CURVES[k]) + 1)]) for c, cw, types in TAXONOMY for t, w, k in types]
    return spark.createDataFrame(rows, "type string, category string, type_weight int, category_weight int, points array<int>")


def usable(destinations: DataFrame, keep_unnamed: bool = False) -> DataFrame:
    """Destinations with a name, a type and a place; ``keep_unnamed`` doesn't ask for the name."""
    named = F.lit(True) if keep_unnamed else F.col("name").isNotNull()
    return destinations.filter(named & F.col("type").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())


def of_taxonomy(spark: SparkSession, features: DataFrame, tag: str = "amenity") -> DataFrame:
    """The features whose ``tag`` is a type of the taxonomy, with it as ``type``."""
    types = F.broadcast(taxonomy(spark).select("type"))  # the fixed table above
    return features.withColumn("type", F.col(tag)).join(types, "type", "left_semi")


def first_at_place(destinations: DataFrame, order: list[str]) -> DataFrame:
    """One destination for each place, the first by ``order``."""
    rest = [c for c in destinations.columns if c not in ("lon", "lat")]
    return destinations.groupBy("lon", "lat").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("d")).select("lon", "lat", "d.*")


def representatives(hexes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hex, node): the node nearest to each hexagon's centre (hex, x, y)."""
    other = nodes.select("node", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return nearest(hexes, other, "hex", "node").select("hex", "node")


def hex_distances(rep: DataFrame, edges: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(a, b, distance) of all pairs of hexagons with a way between their nodes; one search for each distinct node."""
    d = distances(edges, rep.select("node"), cutoff)
    from_, to = rep.select(F.col("hex").alias("a"), F.col("node").alias("source")), rep.select(F.col("hex").alias("b"), F.col("node").alias("target"))
    return d.join(from_, "source").join(to, "target").filter("a <> b").select("a", "b", "distance")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "length", "lts").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "lts"))


def low_stress_distances(rep: DataFrame, edges: DataFrame, cutoff: float | None = None) -> DataFrame:
    return hex_distances(rep, by_stress(edges, 1, 2), cutoff)


def connected(baseline: DataFrame, low: DataFrame, detour: float = DETOUR) -> DataFrame:
    """(a, b, connected): whether the low-stress way is at most ``detour`` times as long; pairs with any way are listed."""
    both = baseline.withColumnRenamed("distance", "base").join(low.withColumnRenamed("distance", "low"), ["a", "b"], "full")
    return both.select("a", "b", F.coalesce(F.col("low").isNotNull() & (F.col("base").isNull() | (F.col("low") <= detour * F.col("base"))), F.lit(False)).alias("connected"))


def _at_nodes(destinations: DataFrame, nodes: DataFrame) -> DataFrame:
    return nearest(destinations, nodes.select("node", F.col("x").alias("rx"), F.col("y").alias("ry")), "id", "node").select("id", "type", F.col("node").alias("target"))


def accessible(rep: DataFrame, destinations: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(hex, id, type, distance): destinations (id, type, x, y) at most ``radius`` away on the network."""
    d = distances(edges, rep.select("node"), radius)
    return d.join(rep.withColumnRenamed("node", "source"), "source").join(_at_nodes(destinations, nodes), "target").select("hex", "id", "type", "distance")


def accessible_types(rep: DataFrame, destinations: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(hex, type, n, distance): ``accessible`` counted by type, with the distance of the nearest.

    Destinations are counted by node and type before they meet the hexagons, so no pair of both becomes a row.
    """
    at = _at_nodes(destinations, nodes).groupBy("target", "type").agg(F.count("*").alias("n"))
    d = distances(edges, rep.select("node"), radius)
    return d.join(rep.withColumnRenamed("node", "source"), "source").join(at, "target").groupBy("hex", "type").agg(F.sum("n").alias("n"), F.min("distance").alias("distance"))


def type_scores(reached: DataFrame, hexes: DataFrame, key: str = "hex") -> DataFrame:
    """(hex, type, category, n, score, type_weight, category_weight): every hexagon with every type, 0 where nothing is in reach.

    The taxonomy's 21 rows of fixed values are broadcast and exploded for each hexagon.
    """
    spark = reached.sparkSession
    types = taxonomy(spark).agg(F.collect_list(F.struct("type", "category", "type_weight", "category_weight", "points")).alias("types")).withColumn("one", F.lit(1))
    every = hexes.select(key).distinct().withColumn("one", F.lit(1)).join(F.broadcast(types), "one").select(key, F.explode("types").alias("t")).select(key, "t.*")
    counts = reached.groupBy(key, "type").agg(F.count("*").alias("n"))
    df = every.join(counts, [key, "type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.col("points")[F.least(F.col("n"), F.size("points") - 1).cast("int")]
    return df.select(key, "type", "category", "n", score.alias("score"), "type_weight", "category_weight")


def category_scores(scores: DataFrame, key: str = "hex") -> DataFrame:
    return scores.groupBy(key, "category", "category_weight").agg((F.sum(F.col("score") * F.col("type_weight")) / 100).alias("score"))


def total_scores(scores: DataFrame, key: str = "hex") -> DataFrame:
    return category_scores(scores, key).groupBy(key).agg((F.sum(F.col("score") * F.col("category_weight")) / 100).alias("total_score"))


def overall_score(totals: DataFrame, population: DataFrame, key: str = "hex") -> DataFrame:
    """The mean of the hexagons' scores weighted by population; a hexagon counts once."""
    return totals.join(population, key).agg((F.sum(F.col("total_score") * F.col("population")) / F.sum("population")).alias("overall_score"))


def score_histogram(totals: DataFrame) -> DataFrame:
    """(score, n) of scores rounded half to even."""
    return totals.groupBy(F.bround("total_score").cast("int").alias("score")).agg(F.count("*").alias("n"))


def score_band(score: Column) -> Column:
    return F.when(score > 20, "over 20").when(score > 10, "over 10").when(score > 5, "over 5").otherwise("rest")


def population_band(population: Column, total: Column) -> Column:
    return F.when(population > 0.02 * total, "over 2 %").when(population > 0.01 * total, "over 1 %").otherwise("rest")


def hex_sums(points: DataFrame, hexes: DataFrame, size: float, value: str | None = None, count_empty: bool = False) -> DataFrame:
    """(q, r, n) or, with ``value``, its sum, for all of ``hexes`` (q, r). ``count_empty`` gives empty hexagons a count of 1."""
    of = F.sum(value) if value else F.count("*")
    name = value or "n"
    sums = with_hex(points, size).groupBy("q", "r").agg(of.alias(name))
    return hexes.select("q", "r").join(sums, ["q", "r"], "left").withColumn(name, F.coalesce(name, F.lit(1 if count_empty and not value else 0)))


def hex_edges(edges: DataFrame, nodes: DataFrame, size: float, low_only: bool = False) -> DataFrame:
    """(q, r, u, v): the streets that leave each hexagon's nodes (node, x, y), a row each; ``low_only``: those of low stress."""
    at = with_hex(nodes.select(F.col("node").alias("u"), "x", "y"), size).select("u", "q", "r")
    of = edges.filter(F.col("lts").isin(1, 2)) if low_only else edges
    return of.select("u", "v").join(at, "u").select("q", "r", "u", "v").distinct()


def hex_means(points: DataFrame, values: DataFrame, size: float, columns: list[str], key: str = "node") -> DataFrame:
    """(q, r, n and the mean of each column) of ``values`` (key, columns) by the hexagon of their point (key, x, y)."""
    at = with_hex(points.select(key, "x", "y"), size).select(key, "q", "r")
    return values.join(at, key).groupBy("q", "r").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def prevalent_stress(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, lts, not_cyclable): the most frequent stress of a hexagon's streets, ties to the lower one, and whether a name bars bicycles."""
    from .lts import bars_bicycles

    counts = edges.filter("lts IS NOT NULL").groupBy(*key, "lts").agg(F.count("*").alias("n"))
    mode = counts.groupBy(*key).agg(F.max_by("lts", F.struct("n", -F.col("lts"))).alias("lts"))
    named = edges.groupBy(*key).agg(F.bool_or(bars_bicycles(F.col("name"))).alias("not_cyclable"))
    return named.join(mode, key, "left").select(*key, "lts", "not_cyclable")


def null_audit(df: DataFrame) -> DataFrame:
    """(column, n_null, n): a row for each column."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"`{c}`".strip("`")) for c in df.columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null"), F.col("_n").alias("n")) for c in df.columns))).alias("a")).select("a.*")


def rank_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")
