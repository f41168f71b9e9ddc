"""Rounds over stored frontiers give what searches of a whole graph give: the same rows with the limit at 0."""

import pytest
from pyspark.sql import functions as F

from pedalspark.operators import frontiers, gaps, paths

from .test_network import frame, nodes_of, random_edges


def rows_of(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    """Whole lengths, so that many paths tie."""
    return frame(spark, random_edges(12, 7, 20)).cache(), nodes_of(spark, 8)


MEASURES = {
    "closeness": lambda e, n: paths.closeness(e, n),
    "betweenness": lambda e, n: paths.betweenness(e, n),
    "edge_betweenness": lambda e, n: paths.edge_betweenness(e, n),
    "local_betweenness": lambda e, n: paths.local_betweenness(e, n, 12.0),
    "paths": lambda e, n: paths.distances(e, n.filter("node % 3 = 0"), 14.0, with_path=True),
    "gap_paths": lambda e, n: gaps.high_stress_paths(e, ["k"]),
    "gap_paths_compat": lambda e, n: gaps.high_stress_paths(e, ["k"], compat=True),
}


@pytest.mark.parametrize("name", MEASURES)
def test_same_rows_without_a_copy_of_the_graph(graph, name, monkeypatch):
    edges, nodes = graph
    expected = rows_of(MEASURES[name](edges, nodes))
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(paths, "graph_of", None)  # no copy of the graph is made
    assert rows_of(MEASURES[name](edges, nodes)) == expected and expected


def test_several_passes(graph, monkeypatch):
    edges, nodes = graph
    expected = rows_of(paths.betweenness(edges, nodes))
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(frontiers, "ROWS", 30)
    assert rows_of(paths.betweenness(edges, nodes)) == expected


def test_no_edges_and_lengths_of_zero(spark, monkeypatch):
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
    empty = frame(spark, [])
    assert rows_of(paths.betweenness(empty, nodes_of(spark, 3))) == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert rows_of(paths.edge_betweenness(empty, nodes_of(spark, 3))) == []
    with pytest.raises(ValueError):
        paths.betweenness(frame(spark, [(0, 1, 0.0, 1, 0)]), nodes_of(spark, 2))


def test_levels_follow_the_longest_way(spark):
    steps = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (0, 2, 3)], "source long, u long, v long")
    nodes, levels = frontiers.settled(steps, spark.createDataFrame([(0,)], "node long"))
    assert levels == 4 and {(r.node, r.level, r.paths) for r in nodes.collect()} == {(0, 0, 1.0), (1, 1, 1.0), (2, 2, 2.0), (3, 3, 2.0)}


def test_marks_double_their_reach(spark):
    """A path of 40 hops: a mark on its first step reaches its end, a forbidden one in the middle cuts off what follows."""
    steps = spark.range(40).select(F.lit(0).cast("long").alias("source"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    start = spark.createDataFrame([(0,)], "node long")
    marks = spark.createDataFrame([(0, 1, 1), (25, 26, 2)], "u long, v long, mark int")
    assert {r.node for r in frontiers.unmarked(steps, start, marks).collect()} == set(range(1, 26))
