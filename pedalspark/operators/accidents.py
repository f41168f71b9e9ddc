"""Accident statistics by street, stress and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clean_lanes, clean_speed, mean_of_numbers
from .lts import stress_text
from .spatial import near_segments, within


def in_years(accidents: DataFrame, first: int = 2018, last: int | None = 2023) -> DataFrame:
    return accidents.filter((F.col("anno") >= first) & ((F.col("anno") <= last) if last is not None else F.lit(True)))


def centre(accidents: DataFrame) -> DataFrame:
    return accidents.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def near_edges(accidents: DataFrame, segments: DataFrame, key: str, radius: float = 10.0) -> DataFrame:
    """Accidents (id, x, y) with every street (key, x0, y0, x1, y1, ...) within ``radius``; those without one have nulls."""
    found = near_segments(accidents.select("id", "x", "y"), segments, radius, ["id", key]).drop("x", "y", "distance")
    return accidents.join(found, "id", "left")


def near_nodes(accidents: DataFrame, nodes: DataFrame, radius: float = 10.0) -> DataFrame:
    other = nodes.withColumnsRenamed({"x": "rx", "y": "ry"})
    return accidents.join(within(accidents.select("id", "x", "y"), other, radius).drop("x", "y", "rx", "ry", "distance"), "id", "left")


def with_assumed(df: DataFrame) -> DataFrame:
    """``lanes`` and ``maxspeed`` as text, from the assumed values where the tags are missing."""
    return df.withColumns({"lanes": F.coalesce(F.col("lanes").cast("string"), F.col("lanes_assumed").cast("int").cast("string")), "maxspeed": F.coalesce(F.col("maxspeed").cast("string"), F.col("maxspeed_assumed").cast("int").cast("string"))})


def meetings(found: DataFrame, streets: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(columns, n): rows of ``found`` joined with ``streets`` on ``key``, counted by the streets' ``columns`` before the join."""
    a = found.groupBy(*key).agg(F.count("*").alias("_a"))
    b = streets.groupBy(*key, *columns).agg(F.count("*").alias("_b"))
    return a.join(b, key).groupBy(*columns).agg(F.sum(F.col("_a") * F.col("_b")).alias("n"))


def _count(n: str | None) -> Column:
    """The number of rows, or of those that each stands for."""
    return (F.sum(n) if n else F.count("*")).alias("accident_count")


def by_highway(df: DataFrame, n: str | None = None) -> DataFrame:
    """By street; ``n``, here and below, counts the accidents that a row stands for."""
    return df.filter("highway IS NOT NULL").groupBy("highway").agg(_count(n))


def by_lanes(df: DataFrame, n: str | None = None) -> DataFrame:
    """(lanes, first_lane, accident_count): labels such as "2 or 4", to be ordered by their first number."""
    counts = df.filter("lanes IS NOT NULL").groupBy(clean_lanes(F.col("lanes")).alias("lanes")).agg(_count(n))
    return counts.withColumn("first_lane", F.split("lanes", " or ")[0].try_cast("double"))


def by_maxspeed(df: DataFrame, n: str | None = None) -> DataFrame:
    return df.filter("maxspeed IS NOT NULL").groupBy(clean_speed(F.col("maxspeed")).alias("maxspeed")).agg(_count(n))


def numeric(df: DataFrame) -> DataFrame:
    """``lanes`` as the mean and ``maxspeed`` as the largest of the numbers in the text."""
    return df.withColumns({"lanes": mean_of_numbers(F.col("lanes")), "maxspeed": F.when(F.col("maxspeed").isNotNull(), clean_speed(F.col("maxspeed")).cast("double"))})


def _percent(counts: DataFrame) -> DataFrame:
    """A handful of rows, one for each level."""
    return counts.withColumn("percentage", 100.0 * F.col("accident_count") / F.sum("accident_count").over(Window.partitionBy(F.lit(1))))


def by_lts(df: DataFrame, n: str | None = None) -> DataFrame:
    return _percent(df.filter("lts IS NOT NULL AND lts <> 0").groupBy("lts").agg(_count(n)))


def by_stress(df: DataFrame, n: str | None = None) -> DataFrame:
    return _percent(df.filter("lts IS NOT NULL AND lts <> 0").groupBy(stress_text(F.col("lts")).alias("stress_level")).agg(_count(n)))
