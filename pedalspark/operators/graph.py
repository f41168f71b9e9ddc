"""Street graphs as tables: ``edges`` (u, v, length, lts, ...), ``nodes`` (node, x, y, ...). Counts, components, subgraphs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Links that one task may hold: about 3 MB.
SMALL = 200_000


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree) of the multigraph; a loop counts twice."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    out = F.sum("out").cast("long")
    return ends.groupBy("node").agg((F.count("*") - out).alias("in_degree"), out.alias("out_degree"), F.count("*").alias("degree"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_anti")


def simple_edges(edges: DataFrame, undirected: bool = False, weight: str = "length") -> DataFrame:
    """(u, v, weight): one edge for each pair, the shortest; loops go."""
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")] if undirected else ["u", "v"]
    return edges.filter("u <> v").select(*ends, F.col(weight).alias(weight)).groupBy("u", "v").agg(F.min(weight).alias(weight))


def collapsed(edges: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row for each (u, v) with the values of its last parallel edge by ``order``."""
    return edges.groupBy("u", "v").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("e")).select("u", "v", "e.*")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, average degree, density of the directed multigraph, number of isolates: one row."""
    a, b, c = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges")), isolates(nodes, edges).agg(F.count("*").alias("n_isolates"))
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").join(c.withColumn("k", F.lit(1)), "k")
    n, m = F.col("n_nodes"), F.col("n_edges")
    return one.select("n_nodes", "n_edges", "n_isolates", (2.0 * m / n).alias("average_degree"), (m / (n * (n - 1.0))).alias("density"))


def transitivity(edges: DataFrame) -> DataFrame:
    """(triangles, triads, transitivity) of the simple undirected graph.

    Each edge points to its end of higher degree, so that no node leads to many pairs: triangles are found from wedges
    at their lowest corner.
    """
    simple = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    degree = simple.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    du, dv = (degree.select(F.col("node").alias(c), F.col("d").alias(f"d{c}")) for c in "uv")
    low = F.struct("du", "u") < F.struct("dv", "v")
    pointed = stored(simple.join(du, "u").join(dv, "v").select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b")), "pointed")
    wedges = pointed.join(pointed.select("a", F.col("b").alias("c")), "a").filter("b < c").select("b", "c")
    closing = simple.select(F.col("u").alias("b"), F.col("v").alias("c"))
    triangles = wedges.join(closing, ["b", "c"]).agg(F.count("*").alias("triangles")).withColumn("k", F.lit(1))
    triads = degree.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("triads")).withColumn("k", F.lit(1))
    return triangles.join(triads, "k").select("triangles", "triads", F.when(F.col("triads") > 0, 3.0 * F.col("triangles") / F.col("triads")).otherwise(0.0).alias("transitivity"))


def components(edges: DataFrame, nodes: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(node, component) with the smallest node as the component; nodes without an edge are their own.

    Minima over neighbours alternate with hops along the labels themselves, so rounds grow with the logarithm of a
    component's extent, not with the extent. At most ``small`` (``SMALL``) links are finished by one task at once.
    """
    both = edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = stored(both, "links")
    small = SMALL if small is None else small
    if small and both.limit(small + 1).count() <= small:
        return _with_nodes(stored(both.coalesce(1).mapInArrow(_smallest, "node long, component long"), "labels"), nodes)
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "component", F.least("component", "c").alias("c"))
        # the old label's node takes the new one too, and every label jumps to its own label
        hook = lower.filter("c < component").groupBy(F.col("component").alias("node")).agg(F.min("c").alias("h"))
        hooked = lower.join(hook, "node", "left").select("node", "component", F.least("c", F.coalesce("h", "c")).alias("c"))
        jump = hooked.select(F.col("node").alias("c"), F.col("c").alias("j"))
        new = stored(hooked.join(jump, "c", "left").select("node", F.col("component").alias("before"), F.least("c", F.coalesce("j", "c")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.filter("before <> component").isEmpty():
            break
    return _with_nodes(labels, nodes)


def _smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node of each component of links in both directions, by the same rounds on arrays."""
    table = [tuple(b.column(i).to_numpy().astype(np.int64) for i in range(2)) for b in batches]
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*table) if table else ((), ())))
    ids, at = np.unique(u, return_inverse=True)
    to, label = np.searchsorted(ids, v), np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, at, label[to])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_pydict({"node": ids, "component": ids[label]})


def _strong(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strong components of links by one depth-first search (Tarjan, 1972), named by their smallest node."""
    table = [tuple(b.column(i).to_numpy().astype(np.int64) for i in range(2)) for b in batches]
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*table) if table else ((), ())))
    ids = np.unique(np.concatenate((u, v)))
    a, order = np.searchsorted(ids, u), np.argsort(u, kind="stable")
    to, start = np.searchsorted(ids, v)[order].tolist(), np.searchsorted(np.sort(a), np.arange(len(ids) + 1)).tolist()
    seen, low, found, component = [-1] * len(ids), [0] * len(ids), 0, [-1] * len(ids)
    open_: list[int] = []
    for root in range(len(ids)):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = found
        found += 1
        open_.append(root)
        work = [(root, start[root])]
        while work:
            x, e = work.pop()
            if e < start[x + 1]:
                work.append((x, e + 1))
                y = to[e]
                if seen[y] < 0:
                    seen[y] = low[y] = found
                    found += 1
                    open_.append(y)
                    work.append((y, start[y]))
                elif component[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            if low[x] == seen[x]:
                own = []
                while not own or own[-1] != x:
                    own.append(open_.pop())
                name = min(own)
                for y in own:
                    component[y] = name
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[x])
    yield pa.RecordBatch.from_pydict({"node": ids, "component": ids[np.array(component, np.int64)]})


def _with_nodes(labels: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is None:
        return labels
    return nodes.select("node").distinct().join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _reached(edges: DataFrame, seeds: DataFrame, live: DataFrame) -> DataFrame:
    """(node, root): nodes reached from each root over edges between live nodes of the same region."""
    region = live.select("node", "region")
    inside = stored(edges.join(region.withColumnRenamed("node", "u"), "u").join(region.select(F.col("node").alias("v"), F.col("region").alias("other")), "v").filter("region = other").select("u", "v"), "inside")
    seen = front = stored(seeds, "front")
    while True:
        step = inside.join(front.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), "root").distinct()
        front = stored(step.join(seen, ["node", "root"], "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = stored(seen.unionByName(front), "seen")


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(node, component) of the directed graph, named by the smallest node.

    Each region has a pivot, its smallest node; what the pivot both reaches and is reached from is a component, and the
    rest falls into three regions that are searched at once. Regions start as weakly connected components; nodes without
    an edge in or out within their region are components at once. At most ``small`` (``SMALL``) links are finished by one task.
    """
    links = stored(edges.filter("u <> v").select("u", "v").distinct(), "directed")
    every = nodes.select("node").distinct() if nodes is not None else links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    small = SMALL if small is None else small
    if small and links.limit(small + 1).count() <= small:
        return _with_nodes(stored(links.coalesce(1).mapInArrow(_strong, "node long, component long"), "strong"), every)
    live = stored(components(links, every, small).select("node", F.col("component").cast("string").alias("region")), "live")
    done = None
    while not live.isEmpty():
        pivots = live.groupBy("region").agg(F.min("node").alias("node"))
        seeds = pivots.select("node", F.col("node").alias("root"))
        fore, back = _reached(links, seeds, live), _reached(links.select(F.col("v").alias("u"), F.col("u").alias("v")), seeds, live)
        marks = live.join(fore.select("node", F.col("root").alias("f")), "node", "left").join(back.select("node", F.col("root").alias("b")), "node", "left")
        marks = stored(marks, "marks")
        found = marks.filter("f IS NOT NULL AND b IS NOT NULL").select("node", F.col("f").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = marks.filter("f IS NULL OR b IS NULL")
        tag = F.when(F.col("f").isNotNull(), "f").when(F.col("b").isNotNull(), "b").otherwise("n")
        split = left.select("node", F.md5(F.concat("region", F.lit("/"), tag)).alias("region"))
        # what no longer has both a way in and a way out in its region is alone
        a, b = split.select(F.col("node").alias("u"), F.col("region").alias("ru")), split.select(F.col("node").alias("v"), F.col("region").alias("rv"))
        own = links.join(a, "u").join(b, "v").filter("ru = rv").select("u", "v")
        round_ = stored(split.join(own.select(F.col("u").alias("node")).distinct().withColumn("o", F.lit(1)), "node", "left").join(own.select(F.col("v").alias("node")).distinct().withColumn("i", F.lit(1)), "node", "left"), "round")
        single = round_.filter("o IS NULL OR i IS NULL").select("node", F.col("node").alias("component"))
        done = done.unionByName(single)
        live = round_.filter("o IS NOT NULL AND i IS NOT NULL").select("node", "region")
    return stored(done, "strong") if done is not None else every.select("node", F.col("node").alias("component"))


def by_stress(edges: DataFrame, *levels: int) -> DataFrame:
    """The subgraph that the edges of these levels induce."""
    return edges.filter(F.col("lts").isin(*levels))


def low_stress_components(edges: DataFrame, nodes: DataFrame, small: int | None = None) -> DataFrame:
    """Components of the low-stress edges, with the low-stress nodes that no such edge meets."""
    low = by_stress(edges, 1, 2)
    met = low.select(F.explode(F.array("u", "v")).alias("node")).unionByName(nodes.filter(F.col("lts").isin(1, 2)).select("node")).distinct()
    return components(low, met, small)


def largest(labels: DataFrame, k: int) -> DataFrame:
    """(component, size) of the ``k`` largest, ties to the smaller name."""
    return labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(k)


def top(values: DataFrame, column: str, key: str, k: int) -> DataFrame:
    return values.orderBy(F.desc(column), key).limit(k)


def consolidated(nodes: DataFrame, edges: DataFrame, tolerance: float = 5.0, dead_ends: bool = False) -> DataFrame:
    """(node, junction, x, y): nodes (x, y in metres) at most ``tolerance`` apart, or linked by such, are one junction at their centre."""
    from .spatial import within

    kept = nodes
    if not dead_ends:
        neighbours = edges.filter("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("u").alias("to")))).alias("e")).select("e.*").distinct()
        kept = nodes.join(neighbours.groupBy("node").agg(F.count("*").alias("_n")), "node", "left").filter(F.coalesce("_n", F.lit(0)) != 1).drop("_n")
    kept = stored(kept.select("node", "x", "y"), "junctions")
    close = within(kept, kept.select(F.col("node").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry")), tolerance).filter("node < other")
    labels = components(close.select(F.col("node").alias("u"), F.col("other").alias("v")), kept)
    centre = kept.join(labels, "node").groupBy("component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return labels.join(centre, "component").select("node", F.col("component").alias("junction"), "x", "y")



def reconnected(edges: DataFrame, junctions: DataFrame) -> DataFrame:
    """(u, v, n): the streets between consolidated ``junctions`` (node, junction), those within one left out; n streets each."""
    of = lambda c: junctions.select(F.col("node").alias(c), F.col("junction").alias(f"j{c}"))
    return edges.join(of("u"), "u").join(of("v"), "v").filter("ju <> jv").groupBy(F.col("ju").alias("u"), F.col("jv").alias("v")).agg(F.count("*").alias("n"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, centrality): the degree over the number of other nodes; 0 for nodes without a street."""
    one = nodes.agg((F.count("*") - 1).alias("_n")).withColumn("_k", F.lit(1))
    all_ = nodes.select("node").join(degrees(edges).select("node", "degree"), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return all_.withColumn("_k", F.lit(1)).join(one, "_k").select("node", "degree", (F.col("degree") / F.col("_n")).alias("centrality"))
