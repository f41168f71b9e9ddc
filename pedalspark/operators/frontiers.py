"""Shortest paths, path counts and centralities of graphs of any size, by rounds of joins over stored tables.

No task holds the graph and nothing is broadcast by hand. Distances relax by frontiers (``relaxed``). The steps of the
shortest paths from a source make an acyclic graph (``tight``). Its nodes are settled in rounds, each when all of its
predecessors are (``settled``), which counts paths forward; dependencies are summed backward over the same rounds
(``dependencies``; Brandes, 2001). A forest of smallest predecessors is such a graph too: its dependencies are the numbers
of targets behind each node. Marks along paths double their reach in each round (``unmarked``), so rounds grow with the
logarithm of a path's hops.

Sources are taken in passes of about ``ROWS`` rows (source, node), so stored tables stay within bounds that the number of
nodes sets, not its square. Lengths must be positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, table_path
from .graph import simple_edges

#: Rows (source, node) of one pass.
ROWS = 2_000_000_000


def relaxed(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, weight: str = "length") -> DataFrame:
    """(source, target, distance) by rounds of joins: each round extends what improved in the last one."""
    return _relaxed(stored(simple_edges(edges, weight=weight), "simple"), sources, cutoff, weight)


def _relaxed(simple: DataFrame, sources: DataFrame, cutoff: float | None, weight: str) -> DataFrame:
    best = stored(sources.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0.0).alias("distance")).distinct(), "best")
    front = best
    while True:
        step = front.join(simple, front["target"] == simple["u"]).select("source", F.col("v").alias("target"), (F.col("distance") + F.col(weight)).alias("distance"))
        if cutoff is not None:
            step = step.filter(F.col("distance") <= cutoff)
        step = step.groupBy("source", "target").agg(F.min("distance").alias("distance"))
        front = stored(step.join(best.withColumnRenamed("distance", "known"), ["source", "target"], "left").filter("known IS NULL OR distance < known").drop("known"), "front")
        if front.isEmpty():
            return best
        best = stored(best.unionByName(front).groupBy("source", "target").agg(F.min("distance").alias("distance")), "best")


def tight(best: DataFrame, simple: DataFrame, weight: str = "length") -> DataFrame:
    """(source, u, v): the steps of all shortest paths of ``best`` (source, target, distance)."""
    at = best.select("source", F.col("target").alias("u"), F.col("distance").alias("du"))
    to = best.select("source", F.col("target").alias("v"), F.col("distance").alias("dv"))
    reach = F.col("du") + F.col(weight)
    met = at.join(simple, "u").join(to, ["source", "v"])
    return met.filter((F.abs(reach - F.col("dv")) <= 1e-12 * F.greatest(F.lit(1.0), reach)) & (F.col("v") != F.col("source"))).select("source", "u", "v")


def forest(steps: DataFrame) -> DataFrame:
    """The one step into each node that comes from its smallest predecessor."""
    return steps.groupBy("source", "v").agg(F.min("u").alias("u")).select("source", "u", "v")


def settled(steps: DataFrame, sources: DataFrame) -> tuple[DataFrame, int]:
    """((source, node, paths, level), number of levels): path counts of acyclic ``steps`` (source, u, v).

    A node is settled in the round after its last predecessor, which is its level; so steps lead to higher levels.
    """
    into = steps.groupBy("source", "v").agg(F.count("*").alias("steps_in"))
    known = stored(steps.join(into, ["source", "v"]), "steps")
    path, level = table_path(steps.sparkSession, "levels"), 0
    front = stored(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")).distinct(), "front")
    waiting = front.select("source", "node", "paths", F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("steps_in")).limit(0)
    while not front.isEmpty():
        front.write.parquet(f"{path}/level={level}")
        reached = front.join(known, (front["source"] == known["source"]) & (front["node"] == known["u"])).select(known["source"], F.col("v").alias("node"), "paths", F.lit(1).cast("long").alias("got"), "steps_in")
        both = reached.unionByName(waiting).groupBy("source", "node").agg(F.sum("paths").alias("paths"), F.sum("got").alias("got"), F.max("steps_in").alias("steps_in"))
        both = stored(both, "reached")
        front, waiting = both.filter("got = steps_in").select("source", "node", "paths"), both.filter("got < steps_in")
        level += 1
    return steps.sparkSession.read.schema("source long, node long, paths double, level int").parquet(path), level


def dependencies(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, paths, part, credit) of all nodes but the sources: the pairs from the source whose paths pass a node, by their share of paths.

    ``part`` is (1 + credit) / paths: what a node passes on to a predecessor for each of its paths.
    """
    spark = steps.sparkSession
    nodes, levels = settled(steps, sources)
    of = lambda name, level: nodes.select("source", F.col("node").alias(name), F.col("level").alias(level))
    path = table_path(spark, "leveled")
    steps.join(of("u", "lu"), ["source", "u"]).join(of("v", "lv"), ["source", "v"]).write.partitionBy("lv").parquet(path)
    leveled = spark.read.schema("source long, v long, u long, lu int, lv int").parquet(path)
    out, waiting = table_path(spark, "credits"), None
    for level in range(levels - 1, 0, -1):
        here = nodes.filter(F.col("level") == level)
        if waiting is not None:
            here = here.join(waiting.filter(F.col("level") == level).drop("level"), ["source", "node"], "left")
        else:
            here = here.withColumn("behind", F.lit(None).cast("double"))
        behind = F.coalesce("behind", F.lit(0.0))
        here.select("source", "node", "paths", (1 / F.col("paths") + behind).alias("part"), (F.col("paths") * behind).alias("credit")).write.parquet(f"{out}/level={level}")
        done = spark.read.schema("source long, node long, paths double, part double, credit double").parquet(f"{out}/level={level}")
        back = leveled.filter((F.col("lv") == level) & (F.col("lu") > 0)).join(done.select("source", F.col("node").alias("v"), "part"), ["source", "v"])
        back = back.select("source", F.col("u").alias("node"), F.col("lu").alias("level"), F.col("part").alias("behind"))
        if waiting is not None:
            back = back.unionByName(waiting.filter(F.col("level") < level))
        waiting = stored(back.groupBy("source", "node", "level").agg(F.sum("behind").alias("behind")), "behind")
    if levels < 2:
        return nodes.limit(0).select("source", "node", "paths", F.lit(0.0).alias("part"), F.lit(0.0).alias("credit"))
    return spark.read.schema("source long, node long, paths double, part double, credit double").parquet(out)


def in_passes(simple: DataFrame, sources: DataFrame, n_nodes: int, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``each(sources of a pass)`` of all passes."""
    sources = stored(sources.select(F.col("node").cast("long").alias("node")).distinct(), "sources")
    passes = max(1, -(-sources.count() * n_nodes // ROWS))
    parts = [stored(each(sources.filter(F.pmod(F.xxhash64("node"), F.lit(passes)) == k) if passes > 1 else sources), "pass") for k in range(passes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def simple_graph(edges: DataFrame, weight: str = "length") -> DataFrame:
    simple = stored(simple_edges(edges, weight=weight).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col(weight).cast("double").alias(weight)), "simple")
    if not simple.filter(F.col(weight) <= 0).isEmpty():
        raise ValueError(f"{weight} must be positive")
    return simple


def node_credits(edges: DataFrame, sources: DataFrame, n_nodes: int, cutoff: float | None = None, weight: str = "length", trees: bool = False) -> DataFrame:
    """(node, value): what all sources' shortest paths, or with ``trees`` those over smallest predecessors, give to the nodes inside."""
    simple = simple_graph(edges, weight)

    def each(some: DataFrame) -> DataFrame:
        steps = tight(_relaxed(simple, some, cutoff, weight), simple, weight)
        return dependencies(stored(forest(steps) if trees else steps, "steps"), some).groupBy("node").agg(F.sum("credit").alias("value"))

    return in_passes(simple, sources, n_nodes, each).groupBy("node").agg(F.sum("value").alias("value"))


def edge_credits(edges: DataFrame, sources: DataFrame, n_nodes: int, weight: str = "length") -> DataFrame:
    """(u, v, value): what all sources' shortest paths give to the edges."""
    simple = simple_graph(edges, weight)

    def each(some: DataFrame) -> DataFrame:
        steps = stored(tight(_relaxed(simple, some, None, weight), simple, weight), "steps")
        credits = dependencies(steps, some)
        starts = some.select(F.col("node").alias("source"), F.col("node").alias("u"), F.lit(1.0).alias("paths"))
        before = credits.select("source", F.col("node").alias("u"), "paths").unionByName(starts)
        shares = steps.join(credits.select("source", F.col("node").alias("v"), "part"), ["source", "v"]).join(before, ["source", "u"])
        return shares.groupBy("u", "v").agg(F.sum(F.col("paths") * F.col("part")).alias("value"))

    return in_passes(simple, sources, n_nodes, each).groupBy("u", "v").agg(F.sum("value").alias("value"))


def reach_sums(edges: DataFrame, sources: DataFrame, n_nodes: int, weight: str = "length") -> DataFrame:
    """(node, total, reach): sum and number of the distances to every node from the others of ``edges`` turned round."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), weight)
    simple = simple_graph(turned, weight)
    each = lambda some: _relaxed(simple, some, None, weight).groupBy(F.col("source").alias("node")).agg(F.sum("distance").alias("total"), (F.count("*") - 1).alias("reach"))
    return in_passes(simple, sources, n_nodes, each)


def unmarked(steps: DataFrame, sources: DataFrame, marks: DataFrame) -> DataFrame:
    """(source, node) of the trees ``steps`` (source, u, v) whose path has a mark of 1 on some step and of 2 on none.

    ``marks`` (u, v, mark). Each round doubles the stretch of path that a row knows about; rows with a mark of 2 go, and
    with them, in later rounds, all that lead over them.
    """
    known = steps.join(marks.select("u", "v", "mark"), ["u", "v"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    rows = stored(known.filter("mark <> 2").select("source", F.col("v").alias("node"), F.col("u").alias("up"), (F.col("mark") == 1).alias("some")), "stretches")
    while True:
        open_ = rows.filter("up <> source")
        if open_.isEmpty():
            return rows.filter("some").select("source", "node")
        on = rows.select("source", F.col("node").alias("up"), F.col("up").alias("next"), F.col("some").alias("more"))
        further = open_.join(on, ["source", "up"]).select("source", "node", F.col("next").alias("up"), (F.col("some") | F.col("more")).alias("some"))
        rows = stored(rows.filter("up = source").unionByName(further), "stretches")


def traced(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """(source, target, path) of ``pairs`` (source, target) in the trees ``steps``: a step back in each round, for the open pairs alone."""
    open_ = stored(pairs.select("source", "target", F.col("target").alias("at"), F.array("target").alias("path")), "open")
    parts = [open_.filter("at = source")]
    open_ = open_.filter("at <> source")
    while not open_.isEmpty():
        back = open_.join(steps.select("source", F.col("v").alias("at"), "u"), ["source", "at"])
        moved = stored(back.select("source", "target", F.col("u").alias("at"), F.concat(F.array("u"), F.col("path")).alias("path")), "open")
        parts.append(moved.filter("at = source"))
        open_ = moved.filter("at <> source")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("source", "target", "path")


def marked_paths(edges: DataFrame, sources: DataFrame, marks: DataFrame, n_nodes: int, weight: str = "length") -> DataFrame:
    """(source, target, distance, path) between ``sources`` whose path has a mark of 1 on some edge and of 2 on none."""
    simple = simple_graph(edges, weight)
    ends = stored(sources.select(F.col("node").cast("long").alias("target")).distinct(), "ends")

    def each(some: DataFrame) -> DataFrame:
        best = _relaxed(simple, some, None, weight)
        trees = stored(forest(tight(best, simple, weight)), "trees")
        pairs = unmarked(trees, some, marks).withColumnRenamed("node", "target").join(ends, "target")
        return traced(pairs, trees).join(best, ["source", "target"]).select("source", "target", "distance", "path")

    return in_passes(simple, sources, n_nodes, each)


def routes(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, weight: str = "length") -> DataFrame:
    """(source, target, distance, path) of all targets in reach."""
    simple = simple_graph(edges, weight)
    best = _relaxed(simple, sources, cutoff, weight)
    trees = stored(forest(tight(best, simple, weight)), "trees")
    return traced(best.select("source", "target"), trees).join(best, ["source", "target"]).select("source", "target", "distance", "path")
