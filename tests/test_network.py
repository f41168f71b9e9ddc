"""Graph operators against plain Python on small graphs."""

import heapq
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pedalspark.operators import gaps, graph, paths


def random_edges(seed, n=14, m=40, integers=True):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 9)) if integers else rng.random() * 9, rng.choice([0, 1, 2, 3, 4, None]), k) for k in range(m)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, length double, lts int, k long")


def nodes_of(spark, n=14):
    return spark.range(n).withColumnRenamed("id", "node")


def dijkstra(rows, s):
    adj, best, heap = defaultdict(list), {}, [(0.0, s)]
    for u, v, w, *_ in rows:
        adj[u].append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for v, w in adj[u]:
                heapq.heappush(heap, (d + w, v))
    return best


def closure(rows, both=False):
    reach = defaultdict(set)
    for u, v, *_ in rows:
        reach[u].add(v)
        if both:
            reach[v].add(u)
    every = {x for u, v, *_ in rows for x in (u, v)}
    out = {}
    for a in every:
        seen, stack = {a}, [a]
        while stack:
            for y in reach[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        out[a] = seen
    return out


@pytest.mark.parametrize("seed, small", [(1, 0), (2, 0), (1, 1000), (2, 1000)])
def test_components(spark, seed, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", small)
    rows = random_edges(seed, 40, 30)
    df = frame(spark, rows)
    weak = closure(rows, True)
    assert {r.node: r.component for r in graph.components(df).collect()} == {a: min(s) for a, s in weak.items() if any(u != v and a in (u, v) for u, v, *_ in rows)}
    strong = closure(rows)
    expected = {a: min(b for b in s if a in strong[b]) for a, s in strong.items()}
    got = {r.node: r.component for r in graph.strong_components(df).collect()}
    assert {k: v for k, v in expected.items() if k in got} == got
    assert {r.node for r in graph.components(df, nodes_of(spark, 45)).collect()} == set(range(45))


def test_long_chain(spark, monkeypatch):
    assert graph.components(spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))).select("component").distinct().count() == 1
    assert graph.components(spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))).count() == 0
    monkeypatch.setattr(graph, "SMALL", 0)
    df = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph.components(df).select("component").distinct().count() == 1


@pytest.mark.parametrize("seed", [3, 4])
def test_paths(spark, seed):
    rows = random_edges(seed, integers=False)
    df, n = frame(spark, rows), nodes_of(spark)
    real = [r for r in rows if r[0] != r[1]]
    every = {x for r in real for x in r[:2]}
    d = {s: dijkstra(real, s) for s in range(14)}
    got = paths.distances(df, n, with_path=True).collect()
    assert {(r.source, r.target): pytest.approx(r.distance) for r in got} == {(s, t): x for s in every for t, x in d[s].items()}
    cost = {}
    for u, v, w, *_ in real:
        cost[u, v] = min(w, cost.get((u, v), 1e9))
    assert all(sum(cost[x] for x in zip(r.path[:-1], r.path[1:])) == pytest.approx(r.distance) for r in got)
    slow = paths.relaxed(df, n.filter("node < 4"), 12.0).collect()
    assert {(r.source, r.target): pytest.approx(r.distance) for r in slow} == {(s, t): x for s in range(4) for t, x in d[s].items() if x <= 12}
    close = {r.node: r.closeness for r in paths.closeness(df, n).collect()}
    for v in range(14):
        into = [d[s][v] for s in range(14) if v in d[s] and s != v]
        assert close[v] == pytest.approx(len(into) ** 2 / sum(into) / 13 if into else 0)
    local = {r.node: r.betweenness for r in paths.local_betweenness(df, n, 12.0).collect()}
    inside = defaultdict(int)
    for r in got:
        if r.distance <= 12:
            for x in r.path[1:-1]:
                inside[x] += 1
    assert local == {v: pytest.approx(inside[v] / 13) for v in range(14)}


def test_betweenness_shares_ties(spark):
    rows = [(0, 1, 1.0, 1, 0), (0, 2, 1.0, 1, 1), (1, 3, 1.0, 1, 2), (2, 3, 1.0, 1, 3), (3, 4, 1.0, 1, 4)]
    df, n = frame(spark, rows), nodes_of(spark, 5)
    got = {r.node: r.betweenness * 12 for r in paths.betweenness(df, n).collect()}
    assert got == {0: 0, 1: pytest.approx(1), 2: pytest.approx(1), 3: pytest.approx(3), 4: 0}
    edge = {(r.u, r.v): r.betweenness * 20 for r in paths.edge_betweenness(df, n).collect()}
    assert edge[3, 4] == pytest.approx(4) and edge[0, 1] == pytest.approx(2)


def test_counts(spark):
    rows = random_edges(5)
    df = frame(spark, rows)
    degree = {r.node: r.degree for r in graph.degrees(df).collect()}
    assert sum(degree.values()) == 2 * len(rows)
    simple = {frozenset(r[:2]) for r in rows if r[0] != r[1]}
    triangles = sum(all(frozenset(x) in simple for x in itertools.combinations(t, 2)) for t in itertools.combinations(range(14), 3))
    assert graph.transitivity(df).first().triangles == triangles
    one = graph.summary(nodes_of(spark, 16), df).first()
    assert (one.n_nodes, one.n_edges, one.n_isolates) == (16, 40, 16 - len(degree)) and one.average_degree == 5.0
    assert graph.collapsed(df, ["k"], ["lts"]).count() == len({r[:2] for r in rows})


def street(u, v, lts, length=1.0, k=0, name="Via A"):
    return (u, v, length, lts, k, name)


def test_gaps(spark):
    rows = [street(1, 2, 4), street(2, 3, 3, name="Ponte Nuovo"), street(3, 9, 1), street(1, 9, 1, 5.0), street(9, 3, 2, 5.0), street(3, 2, 4), street(2, 1, 4), street(3, 8, 4), street(1, 8, 4)]
    e = spark.createDataFrame([(*r[:4], i, r[5]) for i, r in enumerate(rows)], "u long, v long, length double, lts int, k long, name string")
    assert {r.node for r in gaps.contact_nodes(e).collect()} == {1, 3}
    found = gaps.high_stress_paths(e, ["k"])
    assert {(r.source, r.target): list(r.path) for r in found.collect()} == {(1, 3): [1, 2, 3], (3, 1): [3, 2, 1]}
    assert gaps.one_direction(found, compat=True).count() == 0
    one = gaps.one_direction(found)
    assert [(r.source, r.target) for r in one.collect()] == [(1, 3)]
    detour = gaps.with_detour(one, e).collect()
    assert detour[0].detour == pytest.approx(5.0) and gaps.with_detour(one, e, 6.0).count() == 0
    local = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 40.0)], "node long, betweenness double")
    good = gaps.with_benefit(gaps.with_detour(one, e), local)
    assert gaps.ranked(good).first().rank == 1 and good.first().benefit == 190.0
    assert gaps.declustered(good).count() == 1 and gaps.declustered(good, 200.0).count() == 0
    named = gaps.classified(good, gaps.street_names(good, e, ["k"])).first()
    assert (named.kind, named.names, named.intersections) == ("bridge", ["Via A", "Ponte Nuovo"], [])
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "node long, x double, y double")
    assert [(p.x, p.y) for p in gaps.lines(good, nodes).first().line] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    assert gaps.gap_edges(good, e).filter("is_gap").count() == 2


def test_ranks_are_gapless(spark):
    df = spark.range(500).select(F.col("id").alias("source"), F.lit(0).cast("long").alias("target"), (F.col("id") % 7).cast("double").alias("benefit"))
    rows = gaps.ranked(df).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501)) and [(-r.benefit, r.source) for r in rows] == sorted((-r.benefit, r.source) for r in rows)


def test_nearest_pois(spark):
    e = spark.createDataFrame([(i, i + 1, 1000.0) for i in range(6)], "u long, v long, length double")
    pois = spark.createDataFrame([(7, 0), (8, 6)], "poi long, node long")
    got = [(r.node, r["rank"], r.poi, round(r.seconds)) for r in paths.nearest_pois(e, nodes_of(spark, 7), pois).orderBy("node", "rank").collect()]
    assert (3, 1, 7, 720) in got and (3, 2, 8, 720) in got and (0, 1, 7, 0) in got and not any(n == 0 and p == 8 for n, _, p, _ in got)


def test_declustering_in_rounds(spark, monkeypatch):
    import random

    rng, rows = random.Random(5), {}
    while len(rows) < 60:
        path = rng.sample(range(14), rng.randrange(2, 5))
        rows.setdefault((path[0], path[-1]), (path[0], path[-1], float(rng.randrange(178, 186)), path))
    taken, expected = set(), set()
    for source, target, benefit, path in sorted(rows.values(), key=lambda r: (-r[2], r[0], r[1])):
        steps = {frozenset(x) for x in zip(path, path[1:])}
        if benefit >= 180 and not steps & taken:
            taken |= steps
            expected.add((source, target))
    # no task may hold a whole component
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", None)
    df = spark.createDataFrame(list(rows.values()), "source long, target long, benefit double, path array<long>")
    got = [(r.source, r.target) for r in gaps.declustered(df).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_destinations_in_reach_are_counted_before_they_meet_hexagons(spark):
    """300,000 destinations at one node and 300 hexagons: 9e7 pairs, counted and not made."""
    from pyspark.sql import functions as F

    from pedalspark.operators import access

    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(2, 1, 120.0), (1, 2, 110.0)], "u long, v long, length double")
    rep = spark.range(300).select(F.col("id").cast("string").alias("hex"), (F.col("id") % 2 + 1).alias("node"))
    d = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, "bar").otherwise("cafe").alias("type"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
    rows = access.accessible_types(rep, d, nodes, edges, 2000.0).collect()
    assert {(r.hex, r.type): (r.n, r.distance) for r in rows} == {(str(h), t): (n, 120.0 * (h % 2)) for h in range(300) for t, n in (("bar", 100_000), ("cafe", 200_000))}
