"""Density clusters and their quality.

``dbscan`` works on distinct places with weights, in cells whose diagonal is the radius: all points of a cell with enough
weight are core points and in one cluster, so dense places cost nothing. Only thin cells count neighbours. Cells are
linked where their outermost core points, eight a cell, are close; only pairs that these leave open compare all their core
points, in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import running_before
from ..storage import stored
from .graph import components


#: Distances that a task holds at once when blocks of rows are compared: 512 KB, which stay in a core's cache.
STRIP = 1 << 16
#: Sums by row and cluster that a block of rows may send: 2 MB a column.
SUMS = 1 << 18


def distances_between(x: np.ndarray, y: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` and ``y``, whose squares' sums are ``square``, in one array."""
    d = x @ y.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += square
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def _reach(df: DataFrame) -> DataFrame:
    """Each row for its cell and those around it that the radius can reach: (i, j) becomes the other's cell."""
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4))
    return df.withColumn("_n", F.explode(near)).withColumns({"ti": F.col("i") + F.col("_n.a"), "tj": F.col("j") + F.col("_n.b")}).drop("_n")


def dbscan(points: DataFrame, eps: float, min_samples: int, key: str = "id") -> DataFrame:
    """(key, cluster, core) of points (key, x, y). Clusters are numbered from 0 by their smallest place (x, then y); noise is -1.

    A border point goes to the cluster of its nearest core point, ties to the smaller place.
    """
    side = eps / 2**0.5
    places = points.groupBy("x", "y").agg(F.count("*").alias("w")).withColumns({"i": F.floor(F.col("x") / side), "j": F.floor(F.col("y") / side)})
    places = stored(places.withColumn("p", F.xxhash64("x", "y")), "places")
    cells = places.groupBy("i", "j").agg(F.sum("w").alias("cw"))
    marked = places.join(cells, ["i", "j"])
    dense, thin = marked.filter(F.col("cw") >= min_samples).drop("cw"), marked.filter(F.col("cw") < min_samples).drop("cw")
    # A thin cell's points, fewer than min_samples, meet all places around; they count as partial sums.
    around = _reach(thin.select("i", "j", "p", "x", "y")).select("p", F.col("ti").alias("i"), F.col("tj").alias("j"), "x", "y")
    other = places.select("i", "j", F.col("x").alias("ox"), F.col("y").alias("oy"), "w")
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    weight = around.join(other, ["i", "j"]).filter(d2 <= eps * eps).groupBy("p").agg(F.sum("w").alias("nw"))
    thin_core = thin.join(weight.filter(F.col("nw") >= min_samples).select("p"), "p")
    core = stored(dense.select("i", "j", "p", "x", "y").unionByName(thin_core.select("i", "j", "p", "x", "y")), "core")
    at, plus, minus = F.struct("x", "y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")
    outer = F.array(*(f(at, c) for c in (F.col("x"), F.col("y"), plus, minus) for f in (F.min_by, F.max_by)))
    core_cells = core.groupBy("i", "j").agg(F.min("p").alias("c"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), outer.alias("o"))
    core_cells = stored(core_cells, "cells")
    them = core_cells.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("c").alias("tc"), F.col("o").alias("to"), *(F.col(n).alias(f"t{n}") for n in ("x0", "x1", "y0", "y1")))
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"t{lo}") - F.col(hi), F.col(lo) - F.col(f"t{hi}"))
    near = _reach(core_cells).filter("ti > i OR (ti = i AND tj > j)").join(them, ["ti", "tj"]).filter(gap("x0", "x1") * gap("x0", "x1") + gap("y0", "y1") * gap("y0", "y1") <= eps * eps)
    apart = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
    met = F.exists("o", lambda a: F.exists("to", lambda b: apart(a, b) <= eps * eps))
    judged = stored(near.select("i", "j", "ti", "tj", "c", "tc", met.alias("met")), "cell_pairs")
    pairs = judged.filter(~F.col("met"))
    side_of = lambda a, b: core.join(pairs.select(F.col(a).alias("i"), F.col(b).alias("j"), "c", "tc"), ["i", "j"]).select("c", "tc", "x", "y").toDF("c", "tc", "x", "y")

    def close(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Whether any two core points of two cells are close: blocks that touch first, until one is found."""
        a, b = left[["x", "y"]].to_numpy(), right[["x", "y"]].to_numpy()
        middle = b.mean(0) if len(b) else 0
        a = a[np.argsort(((a - middle) ** 2).sum(1))]
        for k in range(0, len(a), 256):
            for m in range(0, len(b), 4096):
                if (((a[k : k + 256, None] - b[None, m : m + 4096]) ** 2).sum(2) <= eps * eps).any():
                    return pd.DataFrame({"u": [left.c.iloc[0]], "v": [left.tc.iloc[0]]})
        return pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64")})

    found = side_of("i", "j").groupBy("c", "tc").cogroup(side_of("ti", "tj").groupBy("c", "tc")).applyInPandas(close, "u long, v long")
    links = judged.filter("met").select(F.col("c").alias("u"), F.col("tc").alias("v")).unionByName(found)
    labels = components(links, core_cells.select(F.col("c").alias("node")))
    grouped = core.join(core_cells.select("i", "j", "c"), ["i", "j"]).join(labels.withColumnRenamed("node", "c"), "c").select("i", "j", "p", "x", "y", "component")
    grouped = stored(grouped, "grouped")
    first = grouped.groupBy("component").agg(F.min(F.struct("x", "y")).alias("f"))  # a row for each cluster
    numbers = running_before(first.select("component", "f.x", "f.y", F.lit(1).alias("one")), [], ["x", "y"], "one", "cluster").select("component", "cluster")
    rest = stored(places.join(core.select("p"), "p", "left_anti").select("i", "j", "p", "x", "y"), "rest")
    ring = _reach(rest).select("p", "x", "y", F.col("ti").alias("i"), F.col("tj").alias("j"))
    touch = ring.join(grouped.select("i", "j", F.col("x").alias("ox"), F.col("y").alias("oy"), "component"), ["i", "j"]).filter(d2 <= eps * eps)
    border = touch.groupBy("p").agg(F.min_by("component", F.struct(d2, F.col("ox"), F.col("oy"))).alias("component"))
    of_place = grouped.select("p", "component", F.lit(True).alias("core")).unionByName(border.select("p", "component", F.lit(False).alias("core")))
    named = of_place.join(numbers, "component").select("p", "cluster", "core")
    out = points.withColumn("p", F.xxhash64("x", "y")).join(named, "p", "left")
    return out.select(key, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def cluster_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n"))


def cluster_centres(points: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    return points.join(labels, key).filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def noise_share(labels: DataFrame) -> DataFrame:
    return labels.agg(F.avg((F.col("cluster") < 0).cast("double")).alias("noise_share"))


def k_distance(points: DataFrame, k: int = 2, key: str = "id") -> DataFrame:
    """(key, distance) to the k-th nearest other point."""
    from .spatial import nearest_others

    return nearest_others(points, key, k).filter(F.col("rank") == k).select(key, "distance")


def _moments(df: DataFrame, features: list[str]) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in features))


def davies_bouldin(df: DataFrame, features: list[str]) -> DataFrame:
    """Of labelled rows (features, cluster) without noise. Clusters, not rows, are compared with each other."""
    real = df.filter("cluster >= 0")
    centres = _moments(real, features)
    gap = lambda a, b: F.sqrt(sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in features))
    spread = real.join(centres, "cluster").groupBy("cluster").agg(F.avg(gap("", "m_")).alias("s"), *(F.first(f"m_{c}").alias(f"a_{c}") for c in features)).withColumn("k", F.lit(1))
    other = spread.select("k", F.col("cluster").alias("oc"), F.col("s").alias("os"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in features))
    worst = spread.join(other, "k").filter("cluster <> oc").groupBy("cluster").agg(F.max((F.col("s") + F.col("os")) / gap("a_", "b_")).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, features: list[str]) -> DataFrame:
    real = df.filter("cluster >= 0")
    centres = _moments(real, features)
    whole = real.agg(*(F.avg(c).alias(f"w_{c}") for c in features)).withColumn("k", F.lit(1))
    square = lambda a, b: sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in features)
    inner = real.join(centres, "cluster").agg(F.sum(square("", "m_")).alias("inner")).withColumn("k", F.lit(1))
    outer = centres.withColumn("k", F.lit(1)).join(whole, "k").agg(F.sum(F.col("n") * square("m_", "w_")).alias("outer"), F.count("*").alias("g"), F.sum("n").alias("rows")).withColumn("k", F.lit(1))
    return inner.join(outer, "k").select((F.col("outer") / (F.col("g") - 1) / (F.col("inner") / (F.col("rows") - F.col("g")))).alias("calinski_harabasz"))


def silhouette(df: DataFrame, features: list[str]) -> DataFrame:
    """The mean silhouette by Euclidean distance, of rows without noise.

    Rows are compared with distinct places and their weights in blocks of bounded size, ``STRIP`` distances at a time; only
    sums by row and cluster leave a task, ``SUMS`` of a block at most. Blocks are no smaller than that bound and the number
    of tasks ask for, as each row is sent once for each block.
    """
    real = stored(df.filter("cluster >= 0").groupBy(*features, "cluster").agg(F.count("*").alias("w")).withColumn("p", F.monotonically_increasing_id()), "placed")
    most = max(256, SUMS // max(1, real.select("cluster").distinct().count()))
    rows, tasks = real.count(), max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-rows // most), min(-(-rows // 1024), math.isqrt(2 * tasks) + 1))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    mine = real.withColumn("_i", F.pmod(F.xxhash64("p"), F.lit(blocks))).withColumn("_j", each).repartition(tasks, "_i", "_j")
    theirs = real.withColumn("_j", F.pmod(F.xxhash64("p"), F.lit(blocks))).withColumn("_i", each)
    theirs = theirs.toDF(*theirs.columns).repartition(tasks, "_i", "_j")
    strip = STRIP

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"p": [], "cluster": [], "w": [], "c": [], "s": [], "n": []}).astype({"p": "int64", "cluster": "int64", "w": "int64", "c": "int64", "s": "float64", "n": "int64"})
        right = right.sort_values("cluster", kind="stable")
        x, y, weights = (np.ascontiguousarray(t.to_numpy(float).T) for t in (left[features], right[features], right.w))
        found, starts = np.unique(right.cluster.to_numpy(), return_index=True)
        total, rows, many = np.empty((len(left), len(found))), max(1, strip // len(right)), (weights > 1).any()
        far, part = np.empty((rows, len(right))), np.empty((rows, len(right)))
        for i in range(0, len(left), rows):
            n = min(rows, len(left) - i)
            d, t = far[:n], part[:n]
            d[:] = 0
            for a, b in zip(x, y):  # differences, so that equal places are at no distance
                np.subtract(a[i : i + n, None], b, out=t)
                np.multiply(t, t, out=t)
                d += t
            np.sqrt(d, out=d)
            if many:
                d *= weights
            total[i : i + n] = np.add.reduceat(d, starts, axis=1)
        n, k = np.add.reduceat(right.w.to_numpy(), starts), len(found)
        return pd.DataFrame({c: np.repeat(left[c].to_numpy(), k) for c in ("p", "cluster", "w")} | {"c": np.tile(found, len(left)), "s": total.ravel(), "n": np.tile(n, len(left))})

    parts = mine.groupBy("_i", "_j").cogroup(theirs.groupBy("_i", "_j")).applyInPandas(sums, "p long, cluster long, w long, c long, s double, n long")
    whole = parts.groupBy("p", "cluster", "w", "c").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("c") == F.col("cluster"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(F.lit(-1.0))))
    other = F.min(F.when(F.col("c") != F.col("cluster"), F.col("s") / F.col("n")))
    each = whole.groupBy("p", "cluster", "w").agg(own.alias("a"), other.alias("b"))
    value = F.when(F.col("a") < 0, 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return each.agg((F.sum(value * F.col("w")) / F.sum("w")).alias("silhouette"))
