"""Gaps of the low-stress network: identify, rank, decluster and classify.

``compat=True`` keeps three habits of the original procedure: pairs of equal hop count vanish in both directions, gaps
without any low-stress way are dropped, and paths along which no stress is known count as stressful.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import running_before
from ..storage import stored
from .graph import by_stress
from .paths import distances, marked_paths


def contact_nodes(edges: DataFrame) -> DataFrame:
    """Nodes from which both low-stress and high-stress streets leave."""
    low, high = F.bool_or(F.coalesce(F.col("lts").isin(1, 2), F.lit(False))), F.bool_or(F.coalesce(F.col("lts").isin(3, 4), F.lit(False)))
    return edges.groupBy(F.col("u").alias("node")).agg(low.alias("low"), high.alias("high")).filter("low AND high").select("node")


def hops(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hop, u, v) of each step of ``path``."""
    steps = F.when(F.size("path") > 1, F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path") - 1).alias("v")))
    return paths.select(*keys, F.posexplode(steps).alias("hop", "s")).select(*keys, "hop", "s.u", "s.v")


def hop_stress(edges: DataFrame, order: list[str]) -> DataFrame:
    """(u, v, hop_lts): the stress of the first parallel street, by ``order``, that has one other than 0."""
    return edges.filter("lts <> 0").groupBy("u", "v").agg(F.min_by("lts", F.struct(*order)).alias("hop_lts"))


def high_stress_paths(edges: DataFrame, order: list[str], compat: bool = False) -> DataFrame:
    """(source, target, distance, path) between contact nodes whose shortest path has high stress on every hop.

    Hops without known stress pass, but for a path of such hops alone, which only ``compat`` lets pass.
    """
    high = F.when(F.col("hop_lts").isin(3, 4), 1).otherwise(2)
    marks = hop_stress(edges, order).select("u", "v", high.alias("mark"))
    if compat:  # what has no stress counts as stressful
        pairs = edges.select("u", "v").distinct()
        marks = pairs.join(marks, ["u", "v"], "left").withColumn("mark", F.coalesce("mark", F.lit(1)))
    return marked_paths(edges, stored(contact_nodes(edges), "contacts"), marks)


def one_direction(paths: DataFrame, compat: bool = False) -> DataFrame:
    """Of a path and its reverse the one of fewer hops; of equal ones the one from the smaller node."""
    back = paths.select(F.col("target").alias("source"), F.col("source").alias("target"), F.size("path").alias("back"))
    shorter = F.col("back").isNull() | (F.size("path") < F.col("back"))
    if not compat:
        shorter = shorter | ((F.size("path") == F.col("back")) & (F.col("source") < F.col("target")))
    return paths.join(back, ["source", "target"], "left").filter(shorter).drop("back")


def with_detour(paths: DataFrame, edges: DataFrame, least: float = 2.0, compat: bool = False) -> DataFrame:
    """Paths whose low-stress way is at least ``least`` times as long; those without one are kept with a null detour, or dropped if ``compat``."""
    low = distances(by_stress(edges, 1, 2), paths.select(F.col("source").alias("node"))).withColumnRenamed("distance", "low")
    both = paths.join(low, ["source", "target"], "inner" if compat else "left").withColumn("detour", F.col("low") / F.col("distance"))
    return both.filter((F.col("detour") >= least) | F.col("detour").isNull()).drop("low")


def with_benefit(gaps: DataFrame, local: DataFrame) -> DataFrame:
    """``gaps`` with the sum of their nodes' betweenness (``local``: node, betweenness), 0 for gaps of no length."""
    points = gaps.select("source", "target", F.explode("path").alias("node"))
    sums = points.join(local, "node").groupBy("source", "target").agg(F.sum("betweenness").alias("s"))
    return gaps.join(sums, ["source", "target"], "left").withColumn("benefit", F.when(F.col("distance") > 0, F.coalesce("s", F.lit(0.0))).otherwise(0.0)).drop("s")


def ranked(gaps: DataFrame) -> DataFrame:
    """``gaps`` with rank 1 for the largest benefit, ties to smaller ids; no two share one.

    Ranks count on from each range of benefits to the next, so no task orders them all.
    """
    ordered = gaps.withColumns({"_down": -F.col("benefit"), "_one": F.lit(1)})
    return running_before(ordered, [], ["_down", "source", "target"], "_one", "_b").withColumn("rank", F.col("_b") + 1).drop("_down", "_one", "_b")


def declustered(gaps: DataFrame, least: float = 180.0) -> DataFrame:
    """Gaps of at least ``least`` benefit that share no street with a better one that is kept, ties to smaller ids.

    Each round keeps the open gaps that are best on all their streets and drops those that share a street with them.
    """
    good = stored(gaps.filter(F.col("benefit") >= least), "good")
    steps = hops(good, ["source", "target", "benefit"]).select("source", "target", "benefit", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    sizes = steps.groupBy("source", "target").agg(F.count("*").alias("n"))
    open_ = stored(steps.join(sizes, ["source", "target"]), "open")
    kept = good.filter("coalesce(size(path), 0) < 2").select("source", "target")  # no street to share
    while not open_.isEmpty():
        best = open_.groupBy("a", "b").agg(F.min_by(F.struct("source", "target", "n"), F.struct(-F.col("benefit"), "source", "target")).alias("g"))
        won = stored(best.groupBy("g").agg(F.count("*").alias("won")).filter("won = g.n").select("g.source", "g.target"), "won")
        taken = open_.join(won, ["source", "target"]).select("a", "b").distinct()
        gone = open_.join(taken, ["a", "b"]).select("source", "target").distinct()
        open_ = stored(open_.join(gone, ["source", "target"], "left_anti"), "open")
        kept = stored(kept.unionByName(won), "kept")
    return good.join(kept, ["source", "target"])


def street_names(gaps: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """(source, target, names): distinct street names along each path, in order."""
    first = edges.filter("name IS NOT NULL").groupBy("u", "v").agg(F.min_by("name", F.struct(*order)).alias("name"))
    named = hops(gaps, ["source", "target"]).join(first, ["u", "v"], "left")
    listed = named.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("hop", "name"))).alias("h"))
    return listed.select("source", "target", F.array_distinct(F.filter(F.transform("h", lambda x: x["name"]), lambda x: x.isNotNull())).alias("names"))


def classified(gaps: DataFrame, names: DataFrame) -> DataFrame:
    """``gaps`` with names, kind and intersections: bridges have none, streets the path's nodes after the first."""
    bridge = F.exists("names", lambda x: F.lower(x).contains("ponte"))
    df = gaps.join(names, ["source", "target"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return df.withColumn("kind", F.when(bridge, "bridge").otherwise("street")).withColumn("intersections", F.when(F.col("kind") == "bridge", F.array().cast("array<bigint>")).otherwise(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))))


def lines(gaps: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, line): the path's known nodes as array<struct<x, y>>, in order."""
    keys = keys or ["source", "target"]
    points = gaps.select(*keys, F.posexplode("path").alias("i", "node")).join(nodes.select("node", "x", "y"), "node")
    listed = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    return listed.select(*keys, F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def gap_edges(gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with ``is_gap``: all parallel streets of any gap's hops."""
    steps = hops(gaps, ["source", "target"]).select("u", "v").distinct().withColumn("_g", F.lit(True))
    return edges.join(steps, ["u", "v"], "left").withColumn("is_gap", F.coalesce("_g", F.lit(False))).drop("_g")
