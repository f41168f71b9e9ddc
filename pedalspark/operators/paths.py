"""Shortest paths and centralities.

Searches are dealt out by source: each task gets a share of the sources and a compact copy of the graph, which is
broadcast only if it has at most ``BROADCAST_EDGES`` edges. Larger graphs take the same measures by rounds of joins over
stored frontiers, in which nothing is broadcast (``frontiers``). Equal lengths are settled by the smaller predecessor.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import frontiers
from .frontiers import relaxed
from .graph import simple_edges

#: Edges of a graph that every task may hold: about 24 MB.
BROADCAST_EDGES = 1_000_000


class Graph:
    """Arrays by source node: ``ids`` sorted, ``to``, ``weight`` and ``mark`` of node i's edges at start[i] to start[i + 1]."""

    def __init__(self, u: np.ndarray, v: np.ndarray, weight: np.ndarray, nodes: np.ndarray | None = None, mark: np.ndarray | None = None):
        self.ids = np.unique(np.concatenate([u, v] + ([nodes] if nodes is not None else [])))
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        order = np.lexsort((b, a))
        self.to, self.weight = b[order], weight[order].astype(float)
        self.mark = mark[order] if mark is not None else None
        self.start = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def reversed(self) -> Graph:
        out = object.__new__(Graph)
        source = np.repeat(np.arange(len(self.ids)), np.diff(self.start))
        order = np.lexsort((source, self.to))
        out.ids, out.to, out.weight, out.mark = self.ids, source[order], self.weight[order], self.mark[order] if self.mark is not None else None
        out.start = np.searchsorted(self.to[order], np.arange(len(self.ids) + 1))
        return out

    def search(self, source: int, cutoff: float | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(distance, predecessor, settled nodes by distance) from a node's number; inf and -1 where there is no way."""
        distance, before = np.full(len(self.ids), np.inf), np.full(len(self.ids), -1)
        distance[source] = 0.0
        done, settled, heap = np.zeros(len(self.ids), bool), [], [(0.0, source)]
        while heap:
            d, i = heapq.heappop(heap)
            if done[i]:
                continue
            done[i] = True
            settled.append(i)
            a, b = self.start[i], self.start[i + 1]
            to, reach = self.to[a:b], d + self.weight[a:b]
            better = (reach < distance[to]) | ((reach == distance[to]) & (i < before[to]) & ~done[to])
            if cutoff is not None:
                better &= reach <= cutoff
            to, reach = to[better], reach[better]
            distance[to], before[to] = reach, i
            for x in zip(reach.tolist(), to.tolist()):
                heapq.heappush(heap, x)
        return distance, before, settled

    def edge(self, a: int, b: int) -> int:
        """The number of the edge from a to b."""
        return int(self.start[a] + np.searchsorted(self.to[self.start[a] : self.start[a + 1]], b))

    def path(self, before: np.ndarray, node: int) -> list[int]:
        out = [node]
        while before[out[-1]] >= 0:
            out.append(int(before[out[-1]]))
        return out[::-1]


def too_large(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_EDGES + 1).count() > BROADCAST_EDGES


def beyond(edges: DataFrame, nodes: DataFrame) -> bool:
    return too_large(edges) or too_large(nodes)


def graph_of(edges: DataFrame, weight: str = "length", nodes: DataFrame | None = None, marks: DataFrame | None = None) -> Graph:
    """The simple directed graph of ``edges`` on the driver; raises if edges or nodes are not within the limit.

    ``marks`` (u, v, mark): a whole number for each edge, 0 where there is none.
    """
    simple = simple_edges(edges, weight=weight)
    if marks is not None:
        simple = simple.join(marks, ["u", "v"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    simple = stored(simple, "simple")
    named = stored(nodes.select(F.col("node").cast("long")).distinct(), "named") if nodes is not None else None
    if too_large(simple) or named is not None and too_large(named):
        raise ValueError(f"more than {BROADCAST_EDGES} edges or nodes: see frontiers")
    table = simple.toArrow()
    more = named.toArrow().column("node").to_numpy().astype(np.int64) if named is not None else None
    u, v, w = (table.column(c).to_numpy().astype(t) for c, t in (("u", np.int64), ("v", np.int64), (weight, float)))
    return Graph(u, v, w, more, table.column("mark").to_numpy().astype(np.int64) if marks is not None else None)


def by_source(sources: DataFrame, graph: Graph, each: Callable[[Graph, int], pa.RecordBatch], schema: str, tasks: int | None = None) -> DataFrame:
    """``each(graph, number of the source)`` for the nodes of ``sources`` (node) that the graph has."""
    return _dealt(sources, graph, lambda g, numbers: (each(g, i) for i in numbers), schema, tasks)


def _dealt(sources: DataFrame, graph: Graph, work: Callable[[Graph, Iterator[int]], Iterator[pa.RecordBatch]], schema: str, tasks: int | None = None) -> DataFrame:
    spark = sources.sparkSession
    held = spark.sparkContext.broadcast(graph)
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value

        def numbers() -> Iterator[int]:
            for batch in batches:
                for node in batch.column(0).to_pylist():
                    i = int(np.searchsorted(g.ids, node))
                    if i < len(g.ids) and g.ids[i] == node:
                        yield i

        yield from work(g, numbers())

    return sources.select(F.col("node").cast("long")).distinct().repartition(tasks, "node").mapInArrow(run, schema)


def summed(sources: DataFrame, graph: Graph, add: Callable[[Graph, int, np.ndarray], None], of_edges: bool = False) -> DataFrame:
    """(node, value), or (u, v, value) of edges: what ``add`` has added up for all sources. A task sends one row for each node or edge, at its end."""

    def work(g: Graph, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(g.to) if of_edges else len(g.ids))
        for i in numbers:
            add(g, i, total)
        some = np.flatnonzero(total)
        if of_edges:
            names = {"u": g.ids[np.searchsorted(g.start, some, "right") - 1], "v": g.ids[g.to[some]]}
        else:
            names = {"node": g.ids[some]}
        yield pa.RecordBatch.from_pydict({**names, "value": total[some]})

    keys = ["u", "v"] if of_edges else ["node"]
    return _dealt(sources, graph, work, ", ".join(f"{k} long" for k in keys) + ", value double").groupBy(*keys).agg(F.sum("value").alias("value"))


def every_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.explode(F.array("u", "v")).alias("node")).unionByName(nodes.select("node")).distinct()


def distances(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, weight: str = "length", with_path: bool = False) -> DataFrame:
    """(source, target, distance) and the path, an array of nodes, for all targets in reach, the source itself included."""
    if too_large(edges):  # it is the simple graph that counts
        edges = stored(simple_edges(edges, weight=weight), "simple")
    if too_large(edges):
        known = sources.select("node").join(every_node(edges, sources.select("node").limit(0)), "node", "left_semi")
        return (frontiers.routes if with_path else relaxed)(edges, known, cutoff, weight)
    graph = graph_of(edges, weight)

    def each(g: Graph, i: int) -> pa.RecordBatch:
        d, before, settled = g.search(i, cutoff)
        columns = [pa.array(np.full(len(settled), g.ids[i])), pa.array(g.ids[settled]), pa.array(d[settled])]
        names = ["source", "target", "distance"]
        if with_path:
            columns.append(pa.array([g.ids[g.path(before, t)].tolist() for t in settled], pa.list_(pa.int64())))
            names.append("path")
        return pa.RecordBatch.from_arrays(columns, names)

    return by_source(sources, graph, each, "source long, target long, distance double" + ", path array<long>" * with_path)


def closeness(edges: DataFrame, nodes: DataFrame, weight: str = "length") -> DataFrame:
    """(node, closeness): from incoming distances, times the share of the other nodes in reach."""
    if beyond(edges, nodes):
        n = every_node(edges, nodes).count()
        value = F.when(F.col("total") > 0, F.col("reach") / F.col("total") * F.col("reach") / (n - 1)).otherwise(0.0)
        return frontiers.reach_sums(edges, nodes, n, weight).select("node", value.alias("closeness"))
    graph = graph_of(edges, weight, nodes).reversed()

    def each(g: Graph, i: int) -> pa.RecordBatch:
        d, _, settled = g.search(i)
        total, reach = float(d[settled].sum()), len(settled) - 1
        value = reach / total * reach / (len(g.ids) - 1) if total > 0 else 0.0
        return pa.RecordBatch.from_arrays([pa.array([int(g.ids[i])]), pa.array([value])], ["node", "closeness"])

    return by_source(nodes, graph, each, "node long, closeness double")


def _credits(g: Graph, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node credit, edge numbers, edge credit) of one source's shortest paths, shared among equal ones (Brandes, 2001)."""
    d, _, settled = g.search(i)
    source = np.repeat(np.arange(len(g.ids)), np.diff(g.start))
    finite = np.isfinite(d[source])
    reach = np.where(finite, d[source], 0) + g.weight
    tight = np.flatnonzero(finite & (np.abs(reach - d[g.to]) <= 1e-12 * np.maximum(1, reach)) & (g.to != i))
    tight = tight[np.argsort(d[g.to[tight]], kind="stable")]
    place = np.empty(len(g.ids), np.int64)
    place[settled] = np.arange(len(settled))
    tight = tight[np.argsort(place[g.to[tight]], kind="stable")]
    paths, credit = np.zeros(len(g.ids)), np.zeros(len(g.ids))
    paths[i] = 1
    a, b = source[tight].tolist(), g.to[tight].tolist()
    for x, y in zip(a, b):
        paths[y] += paths[x]
    shares = np.zeros(len(tight))
    for k in range(len(tight) - 1, -1, -1):
        x, y = a[k], b[k]
        shares[k] = paths[x] / paths[y] * (1 + credit[y])
        credit[x] += shares[k]
    credit[i] = 0
    return credit, tight, shares


def betweenness(edges: DataFrame, nodes: DataFrame, weight: str = "length") -> DataFrame:
    """(node, betweenness), over 1/((n - 1)(n - 2)); sources' credits are added up in their tasks."""

    def add(g: Graph, i: int, total: np.ndarray) -> None:
        total += _credits(g, i)[0]

    if beyond(edges, nodes):
        n = every_node(edges, nodes).count()
        sums = frontiers.node_credits(edges, nodes, n, weight=weight)
    else:
        graph = graph_of(edges, weight, nodes)
        n, sums = len(graph.ids), summed(nodes, graph, add)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return every_node(edges, nodes).join(sums, "node", "left").select("node", (F.coalesce("value", F.lit(0.0)) * scale).alias("betweenness"))


def edge_betweenness(edges: DataFrame, nodes: DataFrame, weight: str = "length") -> DataFrame:
    """(u, v, betweenness) of the simple graph's edges, over 1/(n(n - 1))."""

    def add(g: Graph, i: int, total: np.ndarray) -> None:
        _, tight, shares = _credits(g, i)
        total[tight] += shares  # an edge is named once

    if beyond(edges, nodes):
        n = every_node(edges, nodes).count()
        sums = frontiers.edge_credits(edges, nodes, n, weight)
    else:
        graph = graph_of(edges, weight, nodes)
        n, sums = len(graph.ids), summed(nodes, graph, add, of_edges=True)
    all_ = simple_edges(edges, weight=weight).select("u", "v")
    return all_.join(sums, ["u", "v"], "left").select("u", "v", (F.coalesce("value", F.lit(0.0)) / max(1, n * (n - 1))).alias("betweenness"))


def local_betweenness(edges: DataFrame, nodes: DataFrame, cutoff: float = 2000.0, weight: str = "length") -> DataFrame:
    """(node, betweenness): one for each ordered pair within ``cutoff`` whose one shortest path has the node inside, over n - 1."""

    def add(g: Graph, i: int, total: np.ndarray) -> None:
        _, before, settled = g.search(i, cutoff)
        below = np.zeros(len(g.ids))  # targets behind each node in the tree of paths
        for t in reversed(settled[1:]):
            below[before[t]] += 1 + below[t]
        below[i] = 0
        total += below

    if beyond(edges, nodes):
        n = every_node(edges, nodes).count()
        sums = frontiers.node_credits(edges, nodes, n, cutoff, weight, trees=True)
    else:
        graph = graph_of(edges, weight, nodes)
        n, sums = len(graph.ids), summed(nodes, graph, add)
    return nodes.select("node").distinct().join(sums, "node", "left").select("node", (F.coalesce("value", F.lit(0.0)) / max(1, n - 1)).alias("betweenness"))


def marked_paths(edges: DataFrame, sources: DataFrame, marks: DataFrame, weight: str = "length") -> DataFrame:
    """(source, target, distance, path) of the shortest paths between ``sources`` with a mark of 1 on some edge and of 2 on none.

    ``marks`` (u, v, mark). Marks are followed down each tree of paths, so only the paths asked for leave a task.
    """
    if beyond(edges, sources):
        known = sources.select("node").join(every_node(edges, sources.select("node").limit(0)), "node", "left_semi")
        return frontiers.marked_paths(edges, known, marks, every_node(edges, sources).count(), weight)
    graph = graph_of(edges, weight, sources, marks)
    ends = graph.ids[np.isin(graph.ids, sources.select(F.col("node").cast("long")).distinct().toArrow().column("node").to_numpy())]  # within the limit that graph_of checks

    def work(g: Graph, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(len(g.ids), bool)
        wanted[np.searchsorted(g.ids, ends)] = True
        for i in numbers:
            d, before, settled = g.search(i)
            clean, some = np.zeros(len(g.ids), bool), np.zeros(len(g.ids), bool)
            clean[i], found = True, []
            for t in settled[1:]:
                b = before[t]
                if clean[b]:
                    mark = g.mark[g.edge(b, t)]
                    clean[t], some[t] = mark != 2, some[b] or mark == 1
                    if clean[t] and some[t] and wanted[t]:
                        found.append(t)
            paths = [g.ids[g.path(before, t)].tolist() for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), g.ids[i])), pa.array(g.ids[found]), pa.array(d[found]), pa.array(paths, pa.list_(pa.int64()))], ["source", "target", "distance", "path"])

    return _dealt(sources, graph, work, "source long, target long, distance double, path array<long>")


def stress_weighted(edges: DataFrame, penalise: bool = False) -> DataFrame:
    """``edges`` with ``weight``: length / stress, which makes stressful streets shorter, or length * stress if ``penalise``; 1 for stress 0 or none."""
    of = F.col("length") * F.col("lts") if penalise else F.col("length") / F.col("lts")
    return edges.withColumn("weight", F.when(F.col("lts") > 0, of).otherwise(1.0))


def merged(*centralities: DataFrame) -> DataFrame:
    """Tables (node, value) side by side, for the nodes that all have."""
    out = centralities[0]
    for df in centralities[1:]:
        out = out.join(df, "node")
    return out


def stress_weighted_degree(degree: DataFrame, nodes: DataFrame) -> DataFrame:
    return degree.join(nodes.filter("lts IS NOT NULL").select("node", "lts"), "node").select("node", (F.col("degree") * F.col("lts")).alias("weighted_degree"))


def nearest_pois(edges: DataFrame, nodes: DataFrame, pois: DataFrame, seconds: float = 900.0, k: int = 10, kmh: float = 15.0) -> DataFrame:
    """(node, rank, poi, seconds): the ``k`` nearest of ``pois`` (poi, node) by travel time on two-way streets; ties to the smaller poi.

    Searches start at the nodes that have a POI, not at every node.
    """
    from pyspark.sql import Window

    both = edges.select("u", "v", "length").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    timed = both.withColumn("time", F.col("length") / (kmh / 3.6))
    reach = distances(timed, pois.select("node"), seconds, "time").select(F.col("source").alias("at"), F.col("target").alias("node"), F.col("distance").alias("seconds"))
    found = reach.join(pois.select("poi", F.col("node").alias("at")), "at").join(nodes.select("node"), "node")
    order = Window.partitionBy("node").orderBy("seconds", "poi")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("node", "rank", "poi", "seconds")
