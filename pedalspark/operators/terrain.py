"""Slope from elevation rasters in long form (row, col, z), and street context from buildings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentiles, running_before
from ..storage import stored
from .graph import components
from .lts import major_roads, slope_class
from .spatial import beside, nearest_others, within


def slopes(dem: DataFrame, cell: float, tangent_of_ratio: bool = False) -> DataFrame:
    """(row, col, slope): percent from 0 to 100 by Horn's weights over the 3 x 3 neighbourhood; cells at the edge have none.

    Every cell sends its elevation to its neighbours with their weights, so one aggregation takes the place of eight
    joins. ``tangent_of_ratio`` applies a tangent to the ratio, as an older procedure did.
    """
    steps = [(i, j, i * (2 - abs(j)), j * (2 - abs(i))) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    sent = F.explode(F.array(*(F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), (F.col("z") * wi).alias("dy"), (F.col("z") * wj).alias("dx")) for i, j, wi, wj in steps)))
    sums = dem.filter("z IS NOT NULL").select(sent.alias("s")).select("s.*").groupBy("row", "col").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.count("*").alias("n")).filter("n = 8")
    ratio = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (8 * cell)
    percent = (F.tan(ratio) if tangent_of_ratio else ratio) * 100
    return dem.filter("z IS NOT NULL").select("row", "col").join(sums, ["row", "col"]).select("row", "col", F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)).alias("slope"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(row, col, z) of overlapping tiles (tile, row, col, z): the first tile with a value wins."""
    return tiles.filter("z IS NOT NULL").groupBy("row", "col").agg(F.min_by("z", "tile").alias("z"))


def line_cells(x0: Column, y0: Column, x1: Column, y1: Column, cell: float, per_cell: int = 4) -> Column:
    """array<struct<row, col>>: the cells that sample points, ``per_cell`` to a cell's width, of a segment lie in."""
    n = F.ceil(F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / (cell / per_cell)) + 1
    at = lambda a, b, i: F.floor((a + (b - a) * i / n) / cell)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.struct(at(y0, y1, i).alias("row"), at(x0, x1, i).alias("col"))))


def edge_slopes(segments: DataFrame, raster: DataFrame, cell: float, key: str) -> DataFrame:
    """(key, slope, slope_class): the mean of the raster's cells under each segment (x0, y0, x1, y1); null outside the raster."""
    cells = segments.select(key, F.explode(line_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)).alias("c")).select(key, "c.row", "c.col")
    means = cells.join(raster, ["row", "col"], "left").groupBy(key).agg(F.avg("slope").alias("slope"))
    return means.withColumn("slope_class", slope_class(F.col("slope")))


def crossed_cells(x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> Column:
    """array<struct<row, col, length>>: every cell that a segment crosses, in order, with its length there.

    The segment is cut where it meets lines of the grid, and each piece belongs to the cell of its middle, so clipped
    corners count. A segment of no length has its point's cell.
    """
    at = lambda a, b, t: a + (b - a) * t

    def cuts(a: Column, b: Column) -> Column:
        first, last = F.floor(F.least(a, b) / cell) + 1, F.ceil(F.greatest(a, b) / cell) - 1
        return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: (k * cell - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    ends, whole = F.array(F.lit(0.0), F.lit(1.0)), F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    place = lambda t, length: F.struct(F.floor(at(y0, y1, t) / cell).alias("row"), F.floor(at(x0, x1, t) / cell).alias("col"), length.alias("length"))

    def pieces(t: Column) -> Column:
        n = F.size(t) - 1
        return F.filter(F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: place((a + b) / 2, (b - a) * whole)), lambda p: p["length"] > 0)

    cut = F.element_at(F.transform(F.array(F.array_sort(F.concat(ends, cuts(x0, x1), cuts(y0, y1)))), pieces), 1)
    return F.when(whole > 0, cut).otherwise(F.array(place(F.lit(0.0), F.lit(0.0))))


def slopes_by_length(segments: DataFrame, raster: DataFrame, cell: float, key: str) -> DataFrame:
    """(key, slope, slope_class): the mean of the raster under each segment (x0, y0, x1, y1), by its length in each cell; null outside."""
    cells = segments.select(key, F.explode(crossed_cells(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), cell)).alias("c")).select(key, "c.*")
    known = F.when(F.col("slope").isNotNull(), F.col("length"))
    sums = cells.join(raster, ["row", "col"], "left").groupBy(key).agg(F.sum(F.col("slope") * F.col("length")).alias("s"), F.sum(known).alias("n"), F.avg("slope").alias("point"))
    return sums.select(key, F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.col("point")).alias("slope")).withColumn("slope_class", slope_class(F.col("slope")))


def endpoint_slope(z0: Column, z1: Column, length: Column) -> Column:
    """Percent from the ends' elevations; steps of more than 100 m are taken for errors and count as flat."""
    return F.when(F.abs(z1 - z0) > 100, 0.0).otherwise((z1 - z0) / length * 100)


def class_shares(edges: DataFrame) -> DataFrame:
    """(slope_class, n, share) with the share in percent of the streets that have a class, to one decimal."""
    counts = edges.filter("slope_class IS NOT NULL").groupBy("slope_class").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def building_distances(buildings: DataFrame) -> DataFrame:
    """(id, distance): from each building (id, x, y) to its nearest other one."""
    return nearest_others(buildings, "id").select("id", "distance")


def quintiles(distances: DataFrame, column: str = "distance") -> DataFrame:
    """One row, p20 to p100, interpolated linearly."""
    return percentiles(distances, column, {f"p{p}": p / 100 for p in (20, 40, 60, 80, 100)})


def context(edges: DataFrame, buildings: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """``edges`` (x, y of their middle) with context: urban if a building is within ``radius``, else countryside."""
    # streets are copied to the cells around them, and each place of a building stands in its own
    mine = edges.select(key, F.col("x").alias("rx"), F.col("y").alias("ry"))
    places = beside(buildings.select("x", "y"), mine, radius).distinct()
    near = within(places, mine, radius).select(key).distinct().withColumn("_u", F.lit(True))
    return edges.join(near, key, "left").withColumn("context", F.when(F.col("_u"), "urban").otherwise("countryside")).drop("_u")


def context_by_quintile(edges: DataFrame, buildings: DataFrame, key: str = "id") -> DataFrame:
    """The radius is the 60th percentile of the distances between neighbouring buildings."""
    radius = percentiles(building_distances(buildings), "distance", {"p60": 0.6}).first()[0]
    return context(edges, buildings, radius, key) if radius is not None and not math.isnan(radius) else edges.withColumn("context", F.lit("countryside"))


def legacy_network(edges: DataFrame) -> DataFrame:
    """(u, v, group): main roads by the connected part of the network they are in; parts are numbered from 1, the largest first.

    ``filter("group = 1")`` leaves the one network that an older procedure kept.
    """
    roads = stored(major_roads(edges).filter("u <> v").select("u", "v"), "roads")
    labels = stored(components(roads), "labels")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).withColumns({"_down": -F.col("n"), "_one": F.lit(1)})
    numbers = running_before(sizes, [], ["_down", "component"], "_one", "_b").select("component", (F.col("_b") + 1).alias("group"))
    return roads.join(labels.withColumnRenamed("node", "u"), "u").join(numbers, "component").select("u", "v", "group")
