"""Spatial autocorrelation of counts on lines that touch: Moran's I, whole and local.

Quadrants: 1 high-high, 2 low-high, 3 low-low, 4 high-low. Weights are row-standardised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .graph import components
from .spatial import near_segments

QUADRANTS = {1: "high-high", 2: "low-high", 3: "low-low", 4: "high-low"}


def segments(lines: DataFrame, key: str = "id") -> DataFrame:
    """(key, x0, y0, x1, y1, seg) of the steps of ``line``."""
    a, b = F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1)
    steps = F.when(F.size("line") > 1, F.arrays_zip(a.alias("a"), b.alias("b")))
    return lines.select(key, F.posexplode(steps).alias("seg", "s")).select(key, "seg", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def touching(lines: DataFrame, key: str = "id") -> DataFrame:
    """(a, b): ordered pairs of lines that share a vertex."""
    points = lines.select(key, F.explode("line").alias("p")).select(key, "p.x", "p.y").distinct()
    return points.select(F.col(key).alias("a"), "x", "y").join(points.select(F.col(key).alias("b"), "x", "y"), ["x", "y"]).filter("a <> b").select("a", "b").distinct()


def counts_on_lines(points: DataFrame, lines: DataFrame, start: float, key: str = "id", point: str = "pid") -> DataFrame:
    """(key, n): points whose nearest line it is, 0 included. Each point looks in a radius that doubles until it finds one."""
    parts = stored(segments(lines, key), "segments")
    open_, found, radius = points.select(point, "x", "y"), None, start
    box = parts.agg(F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1")), F.min(F.least("y0", "y1")), F.max(F.greatest("y0", "y1"))).first()
    if box[0] is None:
        return lines.select(key, F.lit(0).cast("long").alias("n"))
    mine = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    reach = ((max(box[1], mine[1]) - min(box[0], mine[0])) ** 2 + (max(box[3], mine[3]) - min(box[2], mine[2])) ** 2) ** 0.5 if mine[0] is not None else 0.0
    while True:
        near = near_segments(open_, parts, radius, [point, key, "seg"]).groupBy(point).agg(F.min_by(key, F.struct("distance", key)).alias(key))
        near = stored(near, "near")
        found = near if found is None else found.unionByName(near)
        open_ = open_.join(near.select(point), point, "left_anti")
        if radius > reach or open_.isEmpty():
            break
        radius *= 2
    counts = found.groupBy(key).agg(F.count("*").alias("n"))
    return lines.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _lagged(values: DataFrame, weights: DataFrame, key: str, by: Column) -> DataFrame:
    """(key, g, z, lag, m2, n): deviations from the group's mean and their neighbours' mean."""
    grouped = values.select(key, by.alias("g"), F.col("n").cast("double").alias("y"))
    means = grouped.groupBy("g").agg(F.avg("y").alias("mean"), F.var_pop("y").alias("m2"), F.count("*").alias("size"))
    z = grouped.join(means, "g").withColumn("z", F.col("y") - F.col("mean"))
    other = z.select(F.col(key).alias("b"), F.col("z").alias("zb"))
    lags = weights.join(other, "b").groupBy(F.col("a").alias(key)).agg(F.avg("zb").alias("lag"))
    return z.join(lags, key, "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))


def global_moran(values: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """(n, moran_i) of ``values`` (key, n); lines without a neighbour add nothing to the weights' sum."""
    rows = _lagged(values, weights, key, F.lit(0))
    with_any = weights.select(F.col("a").alias(key)).distinct().withColumn("w", F.lit(1))
    sums = rows.join(with_any, key, "left").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("lag")).alias("cross"), F.sum(F.col("z") * F.col("z")).alias("square"), F.count("w").alias("s0"))
    return sums.select("n", (F.col("n") / F.col("s0") * F.col("cross") / F.col("square")).alias("moran_i"))


def moran_test(values: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """(n, moran_i, expected, variance, z) under normality, for row-standardised weights over symmetric neighbours."""
    found = global_moran(values, weights, key).withColumn("_k", F.lit(1))
    degree = weights.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k"))
    a, b = degree.select(F.col("node").alias("a"), F.col("k").alias("ka")), degree.select(F.col("node").alias("b"), F.col("k").alias("kb"))
    both = stored(weights.join(a, "a").join(b, "b").withColumn("s", 1 / F.col("ka") + 1 / F.col("kb")), "both")
    s1 = both.agg((F.sum(F.col("s") * F.col("s")) / 2).alias("s1")).withColumn("_k", F.lit(1))
    s2 = both.groupBy("a").agg((1 + F.sum(1 / F.col("kb"))).alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("s2"), F.count("*").cast("double").alias("s0")).withColumn("_k", F.lit(1))
    n, s0 = F.col("n").cast("double"), F.col("s0")
    expected = -1 / (n - 1)
    variance = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - expected * expected
    out = found.join(s1, "_k").join(s2, "_k").select("n", "moran_i", expected.alias("expected"), variance.alias("variance"))
    return out.withColumn("z", (F.col("moran_i") - F.col("expected")) / F.sqrt("variance"))


def local_moran(values: DataFrame, weights: DataFrame, key: str = "id", least: int = 3) -> DataFrame:
    """(key, component, z, lag, local_i, quadrant) within each connected component of ``least`` lines or more whose counts differ."""
    labels = components(weights.select(F.col("a").alias("u"), F.col("b").alias("v")))
    own = values.join(labels.withColumnRenamed("node", key), key)
    rows = _lagged(own, weights, key, F.col("component")).filter((F.col("size") >= least) & (F.col("m2") > 0))
    high, near = F.col("z") > 0, F.col("lag") > 0
    quadrant = F.when(high & near, 1).when(~high & near, 2).when(~high & ~near, 3).otherwise(4)
    return rows.select(key, F.col("g").alias("component"), "z", "lag", (F.col("z") * F.col("lag") / F.col("m2") * (F.col("size") - 1) / F.col("size")).alias("local_i"), quadrant.alias("quadrant"))


def significance(local: DataFrame, weights: DataFrame, permutations: int = 999, seed: int = 42, key: str = "id") -> DataFrame:
    """(key, p_sim, z_sim) of local Moran values: neighbours' values drawn anew from the rest of the component.

    Draws are hashes of the seed, the line, the round and the place, so a lost task repeats them. A component's values
    are numbered and looked up by number; lines, not components, are the unit of work.
    """
    numbered = local.select(key, "component", "z", "lag", (F.row_number().over(Window.partitionBy("component").orderBy(key)) - 1).alias("i"), F.count("*").over(Window.partitionBy("component")).alias("size"))
    numbered = stored(numbered, "numbered")
    degree = weights.groupBy(F.col("a").alias(key)).agg(F.count("*").alias("k"))
    draws = numbered.join(degree, key).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("place", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    pick = F.pmod(F.xxhash64(F.lit(seed), key, "round", "place"), F.col("size") - 1)
    draws = draws.select(key, "component", "z", "lag", "round", (pick + (pick >= F.col("i")).cast("int")).alias("i"))
    values = numbered.select("component", "i", F.col("z").alias("drawn"))
    lags = draws.join(values, ["component", "i"]).groupBy(key, "z", "lag", "round").agg(F.avg("drawn").alias("other"))
    stat, real = F.col("z") * F.col("other"), F.col("z") * F.col("lag")
    sums = lags.groupBy(key).agg(F.count_if(stat >= real).alias("larger"), F.count("*").alias("m"), F.avg(stat).alias("mean"), F.stddev_pop(stat).alias("std"), F.first(real).alias("real"))
    return sums.select(key, ((F.least("larger", F.col("m") - F.col("larger")) + 1) / (F.col("m") + 1)).alias("p_sim"), F.when(F.col("std") > 0, (F.col("real") - F.col("mean")) / F.col("std")).alias("z_sim"))


def quadrant_mode(marks: DataFrame, gap: str = "gap") -> DataFrame:
    """(gap, quadrant): the most frequent quadrant of a gap's lines, the smaller on ties, null if it has none."""
    counts = marks.filter("quadrant IS NOT NULL").groupBy(gap, "quadrant").agg(F.count("*").alias("n"))
    mode = counts.groupBy(gap).agg(F.max_by("quadrant", F.struct("n", -F.col("quadrant"))).alias("quadrant"))
    return marks.select(gap).distinct().join(mode, gap, "left")


def components_by_quadrant(marks: DataFrame) -> DataFrame:
    return marks.groupBy("quadrant").agg(F.countDistinct("component").alias("components"))


def component_summary(marks: DataFrame, level: float = 0.05) -> DataFrame:
    """(component, counts, mean_z, share_significant) with the first two as maps by quadrant; all rows count."""
    each = marks.groupBy("component", "quadrant").agg(F.count("*").alias("n"), F.avg("z_sim").alias("z"), F.count_if(F.col("p_sim") < level).alias("s"))
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("quadrant", c))))
    return each.groupBy("component").agg(entry("n").alias("counts"), entry("z").alias("mean_z"), (F.sum("s") / F.sum("n")).alias("share_significant"))


def names_by_quadrant(marks: DataFrame) -> DataFrame:
    """(quadrant, name): distinct street names without brackets and quotes."""
    return marks.select("quadrant", F.explode(F.split(F.regexp_replace("name", "[\\[\\]'\"]", ""), ", ")).alias("name")).filter("name <> ''").distinct()
