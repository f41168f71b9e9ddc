"""Queries on the street graph: components, paths, centralities, gaps, access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import access, gaps, graph, lts, paths, spatial
from ..storage import stored
from .adapters import oracle, table
from .queries_places import HEX, _at, _cells, _hex, placed, points
from .queries_streets import JUNCTIONS, STREETS, junctions, stressed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = ["l_orderkey", "l_linenumber", "length"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {oracle('edges')}, e AS (SELECT u AS node, 1 AS o FROM edges UNION ALL SELECT v, 0 FROM edges) SELECT node, CAST(sum(1 - o) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM e GROUP BY 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(table(spark, sf_dir, "edges"))


@query(f"WITH {oracle('edges')}, e AS (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) SELECT node, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_k_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(graph.degrees(table(spark, sf_dir, "edges")), "degree", "node", 10).select("node", "degree")


@query(f"WITH {oracle('edges')}, {oracle('nodes')}, n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(*) AS m FROM edges), o AS (SELECT count(*) AS o FROM nodes WHERE node NOT IN (SELECT u FROM edges) AND node NOT IN (SELECT v FROM edges)) SELECT n AS n_nodes, m AS n_edges, o AS n_isolates, round(2.0e0 * m / n, 9) AS average_degree, round(m / (n * (n - 1.0e0)), 9) AS density FROM n, m, o")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = graph.summary(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))
    return df.select("n_nodes", "n_edges", "n_isolates", F.round("average_degree", 9).alias("average_degree"), F.round("density", 9).alias("density"))


@query(f"WITH {oracle('nodes')}, {STREETS}, lanes AS (SELECT u, v FROM streets WHERE rule = 'b7') SELECT node FROM nodes WHERE node NOT IN (SELECT u FROM lanes) AND node NOT IN (SELECT v FROM lanes)")
def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions that no street with a bike lane at 51 to 55 km/h meets."""
    return graph.isolates(table(spark, sf_dir, "nodes"), stressed(spark, sf_dir).filter("rule = 'b7'")).select("node")


@query(f"WITH {oracle('edges')}, {oracle('nodes')}, d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1) SELECT node, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / (SELECT count(*) - 1.0e0 FROM nodes), 9) AS centrality FROM nodes LEFT JOIN d USING (node)")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_centrality(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes")).withColumn("centrality", F.round("centrality", 9))


@query(f"WITH {STREETS} SELECT u AS node FROM streets GROUP BY u HAVING bool_or(lts IN (1, 2)) AND bool_or(lts IN (3, 4))")
def contact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.contact_nodes(stressed(spark, sf_dir))


@query(f"""WITH {oracle('edges')}, s AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM edges WHERE u <> v), d AS (SELECT node, count(*) AS d FROM (SELECT u AS node FROM s UNION ALL SELECT v FROM s) GROUP BY 1),
t AS (SELECT count(*) AS n FROM s a JOIN s b ON a.v = b.u JOIN s c ON c.u = a.u AND c.v = b.v), w AS (SELECT CAST(sum(d * (d - 1) / 2) AS BIGINT) AS n FROM d)
SELECT t.n AS triangles, w.n AS triads, round(3.0e0 * t.n / w.n, 9) AS transitivity FROM t, w""")
def transitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitivity(table(spark, sf_dir, "edges")).withColumn("transitivity", F.round("transitivity", 9))


@query(f"WITH {oracle('edges')} SELECT u, v, arg_max(highway, l_orderkey * 10 + l_linenumber + length / 1e6) AS highway FROM edges GROUP BY u, v")
def edge_key_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "edges").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("length") / F.lit(1e6))
    return graph.collapsed(df, ["k"], ["highway"])


def _closure(edges: str) -> str:
    """Recursive CTEs ``reach`` (a, b) over ``edges``, a table of both directions; every node reaches itself."""
    return f"links AS MATERIALIZED ({edges}), reach(a, b) AS (SELECT DISTINCT u, u FROM links UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u)"


_LOW = "SELECT u, v FROM streets WHERE lts IN (1, 2) UNION SELECT v, u FROM streets WHERE lts IN (1, 2)"


@query(f"WITH RECURSIVE {JUNCTIONS}, {_closure(_LOW)}, c AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1) SELECT node, component FROM c UNION SELECT node, node FROM junctions WHERE lts IN (1, 2) AND node NOT IN (SELECT node FROM c)")
def low_stress_components(spark: SparkSession, sf_dir: str, small: int | None = None) -> DataFrame:
    e = stored(stressed(spark, sf_dir).select("u", "v", "lts"), "streets")  # rules once for both branches
    return graph.low_stress_components(e, lts.node_stress(table(spark, sf_dir, "nodes"), e), small)


@query(ORACLES["low_stress_components"])
def low_stress_components_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rounds of joins from the first link on, as larger networks have it."""
    return low_stress_components(spark, sf_dir, 0)


@query(f"WITH RECURSIVE {JUNCTIONS}, {_closure(_LOW)}, c AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1), every AS (SELECT node, component FROM c UNION SELECT node, node FROM junctions WHERE lts IN (1, 2) AND node NOT IN (SELECT node FROM c)) SELECT component, count(*) AS size FROM every GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top10_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the low-stress network."""
    return graph.largest(low_stress_components(spark, sf_dir), 10)


def _strong(edges: str) -> str:
    return f"{_closure(edges)} SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1"


@query(f"WITH RECURSIVE {STREETS}, every AS (SELECT u, v FROM streets UNION SELECT v, v FROM streets), {_strong('SELECT u, v FROM every')}")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(table(spark, sf_dir, "edges"))


@query(ORACLES["scc"])
def scc_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rounds of joins from the first link on, as larger networks have it."""
    return graph.strong_components(table(spark, sf_dir, "edges"), small=0)


@query(f"WITH RECURSIVE {STREETS}, high AS (SELECT u, v FROM streets WHERE lts IN (3, 4)), every AS (SELECT u, v FROM high UNION SELECT v, v FROM high), {_strong('SELECT u, v FROM every')}")
def high_stress_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the high-stress network."""
    return graph.strong_components(graph.by_stress(stressed(spark, sf_dir), 3, 4))


@query(f"""WITH RECURSIVE {oracle('edges')}, {_at('nodes', 'x', 'y')}, ends AS (SELECT node, count(DISTINCT o) AS k FROM (SELECT u AS node, v AS o FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v) GROUP BY 1),
n AS (SELECT node, x, y FROM nodes_at LEFT JOIN ends USING (node) WHERE coalesce(k, 0) <> 1), links AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM n a JOIN n b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 150),
reach(a, b) AS (SELECT node, node FROM n UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u), c AS (SELECT a AS node, min(b) AS junction FROM reach GROUP BY 1)
SELECT node, junction, round(avg(x) OVER (PARTITION BY junction), 4) AS x, round(avg(y) OVER (PARTITION BY junction), 4) AS y FROM c JOIN n USING (node)""")
def consolidated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = graph.consolidated(points(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"), 150.0)
    return df.select("node", "junction", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH RECURSIVE {oracle('edges')}, {_at('nodes', 'x', 'y')}, ends AS (SELECT node, count(DISTINCT o) AS k FROM (SELECT u AS node, v AS o FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v) GROUP BY 1),
n AS (SELECT node, x, y FROM nodes_at LEFT JOIN ends USING (node) WHERE coalesce(k, 0) <> 1), links AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM n a JOIN n b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 150),
reach(a, b) AS (SELECT node, node FROM n UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u), c AS (SELECT a AS node, min(b) AS j FROM reach GROUP BY 1)
SELECT a.j AS u, b.j AS v, count(*) AS n FROM edges e JOIN c a ON e.u = a.node JOIN c b ON e.v = b.node WHERE a.j <> b.j GROUP BY 1, 2""")
def consolidated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges")
    return graph.reconnected(e, graph.consolidated(points(spark, sf_dir, "nodes"), e, 150.0))


#: Lengths count tenths of a millimetre where paths are compared, so that sums are whole numbers and ties are exact.
UNIT = 10_000
CUTOFF = 2000.0
_LENGTH = f"round(length * {UNIT})"


def exact(df: DataFrame, column: str = "length", unit: int = UNIT) -> DataFrame:
    return df.withColumn(column, F.round(F.col(column) * unit))


def _distances(name: str, rows: str, weight: str = _LENGTH) -> str:
    """Recursive CTEs: ``name``_e, the simple edges (u, v, d) of ``rows``, and ``name`` (a, b, d), the distances of all pairs in reach."""
    return f"""{name}_e AS MATERIALIZED (SELECT u, v, CAST(min({weight}) AS BIGINT) AS d FROM ({rows}) WHERE u <> v GROUP BY u, v),
{name}(a, b, d) USING KEY (a, b) AS (SELECT DISTINCT u, u, CAST(0 AS BIGINT) FROM (SELECT u FROM {name}_e UNION SELECT v FROM {name}_e)
 UNION SELECT f.a, e.v, min(f.d + e.d) FROM {name} f JOIN {name}_e e ON f.b = e.u LEFT JOIN recurring.{name} r ON r.a = f.a AND r.b = e.v WHERE r.d IS NULL OR f.d + e.d < r.d GROUP BY f.a, e.v)"""


_BOTH = "SELECT u, v, length, lts FROM streets UNION ALL SELECT v, u, length, lts FROM streets"
_ALL = _distances("dist", "SELECT u, v, length FROM edges")
#: tight (s, u, t): the last steps of the shortest paths from s; walk (s, t, path): all shortest paths; tree: those over the smallest predecessors.
_TIGHT = "tight AS MATERIALIZED (SELECT x.a AS s, e.u, e.v AS t, y.d FROM dist x JOIN dist_e e ON x.b = e.u JOIN dist y ON y.a = x.a AND y.b = e.v AND x.d + e.d = y.d)"
_WALK = f"{_TIGHT}, walk(s, t, path) AS (SELECT a, a, [a] FROM dist WHERE a = b UNION ALL SELECT w.s, k.t, list_append(path, k.t) FROM walk w JOIN tight k ON k.s = w.s AND k.u = w.t), ways AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY s, t) AS share FROM walk)"
_TREE = f"{_TIGHT}, before AS MATERIALIZED (SELECT s, t, min(u) AS u, min(d) AS d FROM tight GROUP BY s, t)"
_LOCAL = f"""near(s, t, path) AS (SELECT a, a, [a] FROM dist WHERE a = b UNION ALL SELECT n.s, k.t, list_append(path, k.t) FROM near n JOIN before k ON k.s = n.s AND k.u = n.t WHERE k.d <= {CUTOFF * UNIT:.0f}),
local AS (SELECT node, coalesce(n, 0) / (SELECT count(*) - 1.0e0 FROM nodes) AS betweenness FROM nodes LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT unnest(path[2:-2]) AS node FROM near WHERE len(path) > 2) GROUP BY 1) USING (node))"""
_N = "(SELECT CAST(count(*) AS DOUBLE) FROM nodes)"


@query(f"WITH RECURSIVE {oracle('edges')}, {_ALL} SELECT a AS source, b AS target, d / {UNIT}.0e0 AS distance FROM dist WHERE d <= {CUTOFF * UNIT:.0f}")
def sssp_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.distances(exact(table(spark, sf_dir, "edges")), table(spark, sf_dir, "nodes"), CUTOFF * UNIT)
    return found.withColumn("distance", F.col("distance") / float(UNIT))


def _closeness(dist: str, unit: int) -> str:
    return f"SELECT node, round(coalesce(n / total * n / ({_N} - 1) * {unit}, 0), 9) AS closeness FROM nodes LEFT JOIN (SELECT b AS node, CAST(count(*) AS DOUBLE) AS n, CAST(sum(d) AS DOUBLE) AS total FROM {dist} WHERE a <> b GROUP BY 1) USING (node)"


@query(f"WITH RECURSIVE {oracle('edges')}, {oracle('nodes')}, {_ALL} {_closeness('dist', UNIT)}")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.closeness(exact(table(spark, sf_dir, "edges")), table(spark, sf_dir, "nodes"))
    return found.withColumn("closeness", F.round(F.col("closeness") * UNIT, 9))


@query(f"WITH RECURSIVE {oracle('edges')}, {oracle('nodes')}, {_ALL}, {_WALK} SELECT node, round(coalesce(c, 0) / (({_N} - 1) * ({_N} - 2)), 9) AS betweenness FROM nodes LEFT JOIN (SELECT node, sum(share) AS c FROM (SELECT unnest(path[2:-2]) AS node, share FROM ways WHERE len(path) > 2) GROUP BY 1) USING (node)")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.betweenness(exact(table(spark, sf_dir, "edges")), table(spark, sf_dir, "nodes")).withColumn("betweenness", F.round("betweenness", 9))


_MEANS = "round(avg(closeness), 7) AS closeness, round(avg(betweenness), 7) AS betweenness, round(avg(degree), 7) AS degree"


@query(f"""WITH RECURSIVE {oracle('edges')}, {_at('nodes', 'x', 'y')}, {_hex('nodes')}, {_ALL}, {_WALK}, near AS ({_closeness('dist', UNIT)}),
between_ AS (SELECT node, sum(share) / (({_N} - 1) * ({_N} - 2)) AS b FROM (SELECT unnest(path[2:-2]) AS node, share FROM ways WHERE len(path) > 2) GROUP BY 1),
ends AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1),
every AS (SELECT q, r, closeness, round(coalesce(b, 0), 9) AS betweenness, degree FROM nodes_hex JOIN near USING (node) LEFT JOIN between_ USING (node) JOIN ends USING (node))
SELECT q, r, count(*) AS n, {_MEANS} FROM every GROUP BY q, r""")
def hex_centrality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = stored(paths.merged(closeness(spark, sf_dir), betweenness(spark, sf_dir), graph.degrees(table(spark, sf_dir, "edges")).select("node", "degree")), "centralities")
    found = access.hex_means(points(spark, sf_dir, "nodes"), values, HEX, ["closeness", "betweenness", "degree"])
    return found.select("q", "r", "n", *(F.round(c, 7).alias(c) for c in ("closeness", "betweenness", "degree")))


@query(f"WITH RECURSIVE {oracle('edges')}, {oracle('nodes')}, {_ALL}, {_WALK}, hops AS (SELECT path, share, unnest(range(1, len(path))) AS i FROM ways) SELECT u, v, round(coalesce(c, 0) / ({_N} * ({_N} - 1)), 9) AS betweenness FROM dist_e LEFT JOIN (SELECT path[i] AS u, path[i + 1] AS v, sum(share) AS c FROM hops GROUP BY 1, 2) USING (u, v)")
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.edge_betweenness(exact(table(spark, sf_dir, "edges")), table(spark, sf_dir, "nodes")).withColumn("betweenness", F.round("betweenness", 9))


@query(f"WITH RECURSIVE {oracle('edges')}, {oracle('nodes')}, {_ALL}, {_TREE}, {_LOCAL} SELECT node, round(betweenness, 9) AS betweenness FROM local")
def local_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.local_betweenness(exact(table(spark, sf_dir, "edges")), table(spark, sf_dir, "nodes"), CUTOFF * UNIT).withColumn("betweenness", F.round("betweenness", 9))


@query(f"WITH RECURSIVE {STREETS}, {oracle('nodes')}, {_distances('dist', 'SELECT u, v, length, lts FROM streets', f'round(CASE WHEN lts > 0 THEN length / lts ELSE 1.0e0 END * {12 * UNIT})')} {_closeness('dist', 12 * UNIT)}")
def lts_weighted_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = exact(paths.stress_weighted(stressed(spark, sf_dir)), "weight", 12 * UNIT)
    return paths.closeness(weighted, table(spark, sf_dir, "nodes"), "weight").withColumn("closeness", F.round(F.col("closeness") * (12 * UNIT), 9))


@query(f"WITH {JUNCTIONS}, e AS (SELECT u AS node FROM streets UNION ALL SELECT v FROM streets), d AS (SELECT node, count(*) AS degree FROM e GROUP BY 1) SELECT node, degree * lts AS weighted_degree FROM d JOIN junctions USING (node) WHERE lts IS NOT NULL")
def lts_weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.stress_weighted_degree(graph.degrees(table(spark, sf_dir, "edges")), junctions(spark, sf_dir))


_NEAREST = "{n} AS (SELECT {k}, arg_min(node, (sqrt((a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y)), node)) AS node FROM ({rows}) a JOIN (SELECT node, x, y FROM nodes_at) n ON true GROUP BY ALL)"
_HEXES = f"SELECT q || '/' || r AS hex, {HEX!r}e0 * {3**0.5!r}e0 * (q + r / 2.0e0) AS x, {HEX!r}e0 * 1.5e0 * r AS y FROM hexes"
_REP = f"{_at('population')}, {_cells('population')}, {_at('nodes', 'x', 'y')}, {_NEAREST.format(n='rep', k='hex', rows=_HEXES)}"
_ROUND = _distances("dist", _BOTH)
_CALM = _distances("calm", f"SELECT * FROM ({_BOTH}) WHERE lts IN (1, 2)")
_PAIRS = "SELECT x.hex AS a, y.hex AS b, d / {unit}.0e0 AS distance FROM {dist} JOIN rep x ON x.node = {dist}.a JOIN rep y ON y.node = {dist}.b WHERE x.hex <> y.hex"
_FLAGS = f"WITH RECURSIVE {STREETS}, {_REP}, {_ROUND}, {_CALM}, base AS ({_PAIRS.format(unit=UNIT, dist='dist')}), low AS ({_PAIRS.format(unit=UNIT, dist='calm')}), flags AS (SELECT a, b, coalesce(low.distance IS NOT NULL AND (base.distance IS NULL OR low.distance <= 1.5e0 * base.distance), false) AS connected FROM base FULL JOIN low USING (a, b))"


@query(f"""WITH RECURSIVE {oracle('edges')}, {_at('nodes', 'x', 'y')}, {_at('destinations')}, {_distances('dist', 'SELECT u, v, length FROM edges UNION ALL SELECT v, u, length FROM edges')},
{_NEAREST.format(n='place', k='poi', rows="SELECT id AS poi, x, y FROM destinations_at WHERE type = 'hospital'")},
found AS (SELECT dist.b AS node, poi, d / {UNIT}.0e0 / (15.0e0 / 3.6e0) AS seconds FROM dist JOIN place ON dist.a = place.node),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY round(seconds, 6), poi) AS INTEGER) AS rank FROM found WHERE seconds <= 900)
SELECT node, rank, poi, round(seconds, 6) AS seconds FROM ranked WHERE rank <= 10""")
def poi_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hospitals are the points of interest."""
    d = points(spark, sf_dir, "destinations").filter("type = 'hospital'")
    at = access.representatives(d.select(F.col("id").alias("hex"), "x", "y"), points(spark, sf_dir, "nodes")).select(F.col("hex").alias("poi"), "node")
    return paths.nearest_pois(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes"), at).withColumn("seconds", F.round("seconds", 6))


def _rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hex, node) of the hexagons of the maps."""
    cells = spatial.hexagons(points(spark, sf_dir, "population"), HEX)
    x, y = geo.hex_centre(F.col("q"), F.col("r"), HEX)
    return stored(access.representatives(cells.select(F.concat_ws("/", "q", "r").alias("hex"), x.alias("x"), y.alias("y")), points(spark, sf_dir, "nodes")), "representatives")


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(access.both_ways(exact(stressed(spark, sf_dir))), "ways")


def _metres(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.col("distance") / float(UNIT))


@query(f"WITH RECURSIVE {STREETS}, {_REP}, {_ROUND} {_PAIRS.format(unit=UNIT, dist='dist')}")
def hex_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metres(access.hex_distances(_rep(spark, sf_dir), _ways(spark, sf_dir)))


@query(f"WITH RECURSIVE {STREETS}, {_REP}, {_CALM} {_PAIRS.format(unit=UNIT, dist='calm')}")
def hex_low_stress_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metres(access.low_stress_distances(_rep(spark, sf_dir), _ways(spark, sf_dir)))


@query(f"{_FLAGS} SELECT * FROM flags")
def hex_connection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep, e = _rep(spark, sf_dir), _ways(spark, sf_dir)
    return access.connected(access.hex_distances(rep, e), access.low_stress_distances(rep, e))


@query(f"{_FLAGS} SELECT connected, count(*) AS n FROM flags GROUP BY 1")
def hex_connection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hex_connection_flags(spark, sf_dir).groupBy("connected").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {STREETS}, {_REP}, {_ROUND}, {_at('destinations')},
{_NEAREST.format(n='place', k='id, type', rows='SELECT id, type, x, y FROM destinations_at WHERE name IS NOT NULL AND type IS NOT NULL')}
SELECT hex, type, count(*) AS n, min(d) / {UNIT}.0e0 AS nearest FROM dist JOIN rep ON rep.node = dist.a JOIN place ON place.node = dist.b WHERE d <= {CUTOFF * UNIT:.0f} GROUP BY 1, 2""")
def access_2km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of each hexagon within 2000 m of streets, by type."""
    d = access.usable(table(spark, sf_dir, "destinations"))
    got = _metres(access.accessible_types(_rep(spark, sf_dir), placed(d), points(spark, sf_dir, "nodes"), _ways(spark, sf_dir), CUTOFF * UNIT))
    return got.select("hex", "type", "n", F.col("distance").alias("nearest"))


def _gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = stored(exact(stressed(spark, sf_dir)).select("u", "v", "length", "lts", "name", "l_orderkey", "l_linenumber"), "streets")
    return e, stored(gaps.one_direction(gaps.high_stress_paths(e, ORDER)), "gaps")


_GAPS = f"""WITH RECURSIVE {STREETS}, {oracle('nodes')}, {_distances('dist', 'SELECT u, v, length FROM streets')}, {_TREE},
contacts AS MATERIALIZED (SELECT u AS node FROM streets GROUP BY u HAVING bool_or(lts IN (1, 2)) AND bool_or(lts IN (3, 4))),
hop AS MATERIALIZED (SELECT u, v, arg_min(lts, (l_orderkey, l_linenumber, length)) AS lts FROM streets WHERE lts <> 0 GROUP BY u, v),
high(s, t, path, seen, d) AS (SELECT node, node, [node], false, CAST(0 AS BIGINT) FROM contacts
 UNION ALL SELECT h.s, k.t, list_append(path, k.t), seen OR lts IS NOT NULL, k.d FROM high h JOIN before k ON k.s = h.s AND k.u = h.t LEFT JOIN hop ON hop.u = k.u AND hop.v = k.t WHERE lts IS NULL OR lts IN (3, 4)),
found AS MATERIALIZED (SELECT s, t, d, path FROM high WHERE seen AND t IN (SELECT node FROM contacts)),
gaps AS MATERIALIZED (SELECT x.* FROM found x LEFT JOIN found y ON y.s = x.t AND y.t = x.s WHERE y.s IS NULL OR len(x.path) < len(y.path) OR len(x.path) = len(y.path) AND x.s < x.t),
steps AS (SELECT s, t, i, path[i] AS u, path[i + 1] AS v FROM (SELECT s, t, path, unnest(range(1, len(path))) AS i FROM gaps))"""
_DETOUR = f"{_GAPS}, {_distances('calm', 'SELECT u, v, length FROM streets WHERE lts IN (1, 2)')}, far AS (SELECT s, t, gaps.d, path, CAST(calm.d AS DOUBLE) / gaps.d AS detour FROM gaps LEFT JOIN calm ON calm.a = s AND calm.b = t WHERE calm.d IS NULL OR CAST(calm.d AS DOUBLE) / gaps.d >= 2)"
_BENEFIT = f"{_DETOUR}, {_LOCAL}, good AS (SELECT s, t, round(sum(betweenness), 6) AS benefit FROM (SELECT s, t, unnest(path) AS node FROM far) JOIN local USING (node) GROUP BY s, t)"


@query(f"{_GAPS} SELECT s AS source, t AS target, d / {UNIT}.0e0 AS distance, array_to_string(path, '-') AS path FROM found")
def high_stress_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(exact(stressed(spark, sf_dir)).select("u", "v", "length", "lts", "l_orderkey", "l_linenumber"), "streets")
    return _metres(gaps.high_stress_paths(e, ORDER)).select("source", "target", "distance", F.array_join("path", "-").alias("path"))


@query(f"{_GAPS} SELECT s AS source, t AS target, CAST(len(path) - 1 AS INTEGER) AS hops FROM gaps")
def gap_direction_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir)[1].select("source", "target", (F.size("path") - 1).alias("hops"))


@query(f"{_DETOUR} SELECT s AS source, t AS target, d / {UNIT}.0e0 AS distance, round(detour, 9) AS detour FROM far")
def gap_detour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _gaps(spark, sf_dir)
    return _metres(gaps.with_detour(found, e)).select("source", "target", "distance", F.round("detour", 9).alias("detour"))


def _benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _gaps(spark, sf_dir)
    local = paths.local_betweenness(e, table(spark, sf_dir, "nodes"), CUTOFF * UNIT)
    return gaps.with_benefit(gaps.with_detour(found, e), local).withColumn("benefit", F.round("benefit", 6))


@query(f"{_BENEFIT} SELECT s AS source, t AS target, benefit FROM good")
def gap_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benefits(spark, sf_dir).select("source", "target", "benefit")


@query(f"{_BENEFIT} SELECT s AS source, t AS target, benefit, row_number() OVER (ORDER BY benefit DESC, s, t) AS rank FROM good")
def gap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.ranked(_benefits(spark, sf_dir)).select("source", "target", "benefit", F.col("rank").cast("long").alias("rank"))


@query()
def gap_decluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a threshold of 1: at the 180 of the original city no gap of this graph is left."""
    return gaps.declustered(_benefits(spark, sf_dir), 1.0).select("source", "target", "benefit")


_NAMES = f"{_GAPS}, called AS (SELECT u, v, arg_min(name, (l_orderkey, l_linenumber, length)) AS name FROM streets WHERE name IS NOT NULL GROUP BY u, v), named AS (SELECT s, t, string_agg(name, '; ' ORDER BY i) AS names, bool_or(lower(name) LIKE '%ponte%') AS bridge FROM (SELECT s, t, name, min(i) AS i FROM steps JOIN called USING (u, v) GROUP BY s, t, name) GROUP BY s, t)"


@query(f"{_NAMES} SELECT s AS source, t AS target, names FROM named")
def gap_edge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _gaps(spark, sf_dir)
    return gaps.street_names(found, e, ORDER).filter(F.size("names") > 0).select("source", "target", F.array_join("names", "; ").alias("names"))


@query(f"{_NAMES} SELECT s AS source, t AS target, CASE WHEN coalesce(bridge, false) THEN 'bridge' ELSE 'street' END AS kind, coalesce(names, '') AS names, CAST(CASE WHEN coalesce(bridge, false) THEN 0 ELSE len(path) - 1 END AS INTEGER) AS n_intersections FROM gaps LEFT JOIN named USING (s, t)")
def gap_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _gaps(spark, sf_dir)
    named = gaps.classified(found, gaps.street_names(found, e, ORDER))
    return named.select("source", "target", "kind", F.array_join("names", "; ").alias("names"), F.size("intersections").alias("n_intersections"))


@query(f"{_GAPS} SELECT s AS source, t AS target, CAST(len(path) AS INTEGER) AS points, x, y FROM gaps JOIN nodes ON node = s")
def gap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _gaps(spark, sf_dir)
    return gaps.lines(found, table(spark, sf_dir, "nodes")).select("source", "target", F.size("line").alias("points"), F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"))


@query(f"{_GAPS} SELECT (u, v) IN (SELECT (u, v) FROM steps) AS is_gap, count(*) AS n FROM streets GROUP BY 1")
def gap_edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, found = _gaps(spark, sf_dir)
    return gaps.gap_edges(found, e).groupBy("is_gap").agg(F.count("*").alias("n"))


@query(f"WITH {STREETS}, {_at('nodes', 'x', 'y')}, {_hex('nodes')} SELECT DISTINCT q, r, u, v FROM streets JOIN (SELECT node AS u, q, r FROM nodes_hex) USING (u) WHERE lts IN (1, 2)")
def hex_low_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.hex_edges(stressed(spark, sf_dir), points(spark, sf_dir, "nodes"), HEX, low_only=True)
