"""Queries on places: spatial joins, hexagons, accidents, destinations, clusters, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, stats
from ..operators import access, accidents, autocorrelation, clusters, clusters_hierarchical, lts, overlay, risk, spatial, terrain
from ..sources import readers
from ..storage import stored
from .adapters import oracle, table
from .queries_streets import STREETS, junctions, stressed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LON0, LAT0, HEX = 11.27, 46.46, 174.0
_KX, _KY = geo.local_factors(LAT0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def placed(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with x, y in metres."""
    x, y = geo.local_xy(F.col(lon), F.col(lat), LON0, LAT0)
    return df.withColumns({"x": x, "y": y})


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return placed(df, "x", "y") if name == "nodes" else placed(df)


def _at(name: str, lon: str = "lon", lat: str = "lat") -> str:
    """A CTE of the adapter with x, y in metres."""
    return f"{oracle(name)}, {name}_at AS (SELECT * EXCLUDE ({lon}, {lat}), ({lon} - {LON0!r}e0) * {_KX!r}e0 AS x, ({lat} - {LAT0!r}e0) * {_KY!r}e0 AS y FROM {name})"


_S3 = 3**0.5 / 3


def _hex(name: str) -> str:
    """A CTE with q, r from x, y."""
    return f"""{name}_f AS (SELECT *, (x * {_S3!r}e0 - y / 3) / {HEX!r}e0 AS fq, (y * 2 / 3) / {HEX!r}e0 AS fr FROM {name}_at),
{name}_r AS (SELECT *, floor(fq + 0.5e0) AS rq, floor(fr + 0.5e0) AS rr, floor(-fq - fr + 0.5e0) AS rs FROM {name}_f),
{name}_hex AS (SELECT * EXCLUDE (fq, fr, rq, rr, rs),
  CAST(CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs - (-fq - fr)) THEN -rr - rs ELSE rq END AS BIGINT) AS q,
  CAST(CASE WHEN (abs(rq - fq) <= abs(rr - fr) OR abs(rq - fq) <= abs(rs - (-fq - fr))) AND abs(rr - fr) > abs(rs - (-fq - fr)) THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM {name}_r)"""


@query(f"WITH {_at('buildings')} SELECT id, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 3) AS distance FROM (SELECT id, x, y FROM buildings_at) a JOIN (SELECT id AS other, x, y FROM buildings_at) b ON a.id <> b.other AND b.x BETWEEN a.x - 400 AND a.x + 400 GROUP BY id")
def building_nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL looks 400 m to either side, which is farther than any building's neighbour."""
    return terrain.building_distances(points(spark, sf_dir, "buildings")).select("id", F.round("distance", 3).alias("distance"))


@query(f"WITH {_at('buildings')}, d AS (SELECT sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS distance FROM (SELECT id, x, y FROM buildings_at) a JOIN (SELECT id AS other, x, y FROM buildings_at) b ON a.id <> b.other AND b.x BETWEEN a.x - 400 AND a.x + 400 GROUP BY id) SELECT {', '.join(f'round(quantile_cont(distance, {p / 100}), 3) AS p{p}' for p in (20, 40, 60, 80, 100))} FROM d")
def context_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = terrain.quintiles(terrain.building_distances(points(spark, sf_dir, "buildings")))
    return q.select(*(F.round(c, 3).alias(c) for c in q.columns))


@query(f"WITH {_at('buildings')}, {_at('nodes', 'x', 'y')} SELECT node, CASE WHEN EXISTS (SELECT 1 FROM buildings_at b WHERE (b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) <= 900) THEN 'urban' ELSE 'countryside' END AS context FROM nodes_at n")
def urban_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.context(points(spark, sf_dir, "nodes"), points(spark, sf_dir, "buildings"), 30.0, "node").select("node", "context")


@query(f"""WITH {_at('buildings')}, {_at('nodes', 'x', 'y')}, d AS (SELECT sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS distance FROM (SELECT id, x, y FROM buildings_at) a JOIN (SELECT id AS other, x, y FROM buildings_at) b ON a.id <> b.other AND b.x BETWEEN a.x - 400 AND a.x + 400 GROUP BY id), far AS (SELECT quantile_cont(distance, 0.6) AS r FROM d)
SELECT node, CASE WHEN EXISTS (SELECT 1 FROM buildings_at b, far WHERE (b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) <= r * r) THEN 'urban' ELSE 'countryside' END AS context FROM nodes_at n""")
def context_by_quintile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.context_by_quintile(points(spark, sf_dir, "nodes"), points(spark, sf_dir, "buildings"), "node").select("node", "context")


_NODES = _at("nodes", "x", "y")


@query(f"WITH {_at('accidents')}, {_NODES}, d AS (SELECT id, node, (a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y) AS d2 FROM accidents_at a JOIN (SELECT node, x, y FROM nodes_at) n ON true) SELECT id, min(node) AS node FROM d JOIN (SELECT id, min(d2) AS d2 FROM d GROUP BY id) m USING (id) WHERE sqrt(d.d2) = sqrt(m.d2) GROUP BY id")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.representatives(points(spark, sf_dir, "accidents").select(F.col("id").alias("hex"), "x", "y"), points(spark, sf_dir, "nodes")).select(F.col("hex").alias("id"), "node")


def pieces(df: DataFrame) -> DataFrame:
    """The short piece of street at the first node of each edge: (u, piece, x0, y0, x1, y1)."""
    return df.select("u", (F.col("v") % 7).alias("piece"), "x0", "y0").distinct().withColumns({"x1": F.col("x0") + (F.col("piece") - 3) * 20.0, "y1": F.col("y0") + (F.col("piece") - 2) * 15.0})


def accidents_on_pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Accidents of the years (id, u, piece) with each piece of street within 10 m, and all streets with their piece."""
    e, n = stressed(spark, sf_dir), points(spark, sf_dir, "nodes").select(F.col("node").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    seg = pieces(table(spark, sf_dir, "edges").select("u", "v").distinct().join(n, "u")).withColumn("s", F.concat_ws("/", "u", "piece"))
    found = spatial.near_segments(accidents.in_years(points(spark, sf_dir, "accidents")).select("id", "x", "y"), seg, 10.0, ["id", "s"]).select("id", "u", "piece")
    return found, accidents.with_assumed(e.withColumn("piece", F.col("v") % 7))


def accidents_on_streets(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(columns, n): how often an accident of the years meets a street whose piece is within 10 m, by the streets' ``columns``.

    Streets and accidents are counted by piece before they meet, so no pair of them becomes a row.
    """
    found, streets = accidents_on_pieces(spark, sf_dir)
    return accidents.meetings(found, streets, ["u", "piece"], list(columns))


_NEAR = f"""WITH {STREETS}, {_NODES}, {_at('accidents')},
seg AS (SELECT DISTINCT u, v % 7 AS piece, n.x AS x0, n.y AS y0, n.x + (v % 7 - 3) * 20.0e0 AS x1, n.y + (v % 7 - 2) * 15.0e0 AS y1 FROM streets JOIN (SELECT node AS u, x, y FROM nodes_at) n USING (u)),
t AS (SELECT id, u, piece, x, y, x0, y0, x1, y1, CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 > 0 THEN greatest(0e0, least(1e0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) ELSE 0e0 END AS t
 FROM (SELECT id, x, y FROM accidents_at WHERE anno BETWEEN 2018 AND 2023) a JOIN seg ON a.x BETWEEN x0 - 100 AND x0 + 100 AND a.y BETWEEN y0 - 100 AND y0 + 100),
near AS (SELECT id, lts, highway, coalesce(lanes, CAST(lanes_assumed AS VARCHAR)) AS lanes, coalesce(maxspeed, CAST(maxspeed_assumed AS VARCHAR)) AS maxspeed
 FROM t JOIN streets s ON t.u = s.u AND t.piece = s.v % 7 WHERE sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) <= 10)"""


@query(f"{_NEAR} SELECT a.id, count(near.id) AS n FROM accidents_at a LEFT JOIN near ON near.id = a.id WHERE anno BETWEEN 2018 AND 2023 GROUP BY 1")
def accident_street_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many streets each accident of the years matches, 0 included."""
    found, streets = accidents_on_pieces(spark, sf_dir)
    n = found.join(streets.groupBy("u", "piece").agg(F.count("*").alias("n")), ["u", "piece"]).groupBy("id").agg(F.sum("n").alias("n"))
    return accidents.in_years(points(spark, sf_dir, "accidents")).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{_NEAR} SELECT kind, count(*) AS n FROM accidents_at WHERE id IN (SELECT id FROM accidents_at a JOIN seg ON a.x BETWEEN x0 - 130 AND x0 + 130 AND a.y BETWEEN y0 - 130 AND y0 + 130 WHERE sqrt((x - x0 - CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 > 0 THEN greatest(0e0, least(1e0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) ELSE 0e0 END * (x1 - x0)) ** 2 + (y - y0 - CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 > 0 THEN greatest(0e0, least(1e0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) ELSE 0e0 END * (y1 - y0)) ** 2) <= 40) GROUP BY 1")
def within_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents at most 40 m from any piece of street, by kind."""
    n = points(spark, sf_dir, "nodes").select(F.col("node").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    seg = pieces(table(spark, sf_dir, "edges").select("u", "v").distinct().join(n, "u"))
    return spatial.near_any(points(spark, sf_dir, "accidents"), seg, 40.0, "id").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{_NEAR} SELECT highway, count(*) AS accident_count FROM near GROUP BY 1")
def accidents_by_highway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accidents.by_highway(accidents_on_streets(spark, sf_dir, "highway"), "n")


@query(f"{_NEAR} SELECT array_to_string(regexp_extract_all(lanes, '\\d+'), ' or ') AS lanes, count(*) AS accident_count, CAST(regexp_extract(lanes, '\\d+') AS DOUBLE) AS first_lane FROM near GROUP BY ALL")
def accidents_by_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accidents.by_lanes(accidents_on_streets(spark, sf_dir, "lanes"), "n")


@query(f"{_NEAR} SELECT CASE WHEN maxspeed LIKE '%IT:urban%' THEN 50 ELSE coalesce(list_max(list_transform(regexp_extract_all(maxspeed, '\\d+'), lambda s: CAST(s AS INTEGER))), 50) END AS maxspeed, count(*) AS accident_count FROM near GROUP BY 1")
def accidents_by_maxspeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accidents.by_maxspeed(accidents_on_streets(spark, sf_dir, "maxspeed"), "n")


@query(f"{_NEAR} SELECT lts, count(*) AS accident_count, round(100.0e0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM near WHERE lts <> 0 GROUP BY 1")
def accidents_by_lts_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accidents.by_lts(accidents_on_streets(spark, sf_dir, "lts"), "n").withColumn("percentage", F.round("percentage", 6))


@query(f"{_NEAR} SELECT CASE WHEN lts IN (1, 2) THEN 'low stress' WHEN lts IN (3, 4) THEN 'high stress' ELSE 'undefined' END AS stress_level, count(*) AS accident_count, round(100.0e0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM near WHERE lts <> 0 GROUP BY 1")
def accidents_by_stress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accidents.by_stress(accidents_on_streets(spark, sf_dir, "lts"), "n").withColumn("percentage", F.round("percentage", 6))


@query(f"WITH {_at('accidents')}, {_NODES} SELECT kind, count(node) AS n_near, count(*) FILTER (node IS NULL) AS n_without FROM (SELECT a.kind, n.node FROM accidents_at a LEFT JOIN (SELECT node, x, y FROM nodes_at) n ON n.x BETWEEN a.x - 60 AND a.x + 60 AND (a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y) <= 2500) GROUP BY 1")
def accidents_near_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = accidents.near_nodes(points(spark, sf_dir, "accidents").select("id", "kind", "x", "y"), points(spark, sf_dir, "nodes").select("node", "x", "y"), 50.0)
    return found.groupBy("kind").agg(F.count("node").alias("n_near"), F.count_if(F.col("node").isNull()).alias("n_without"))


_CELLS = """grid AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {t}_at),
rows_ AS (SELECT x0, x1, unnest(range(CAST(ceil(y0 / (1.5e0 * {h}e0)) AS BIGINT), CAST(floor(y1 / (1.5e0 * {h}e0)) AS BIGINT) + 1)) AS r FROM grid),
hexes AS (SELECT r, unnest(range(CAST(ceil(x0 / {s}e0 - r / 2.0e0) AS BIGINT), CAST(floor(x1 / {s}e0 - r / 2.0e0) AS BIGINT) + 1)) AS q FROM rows_)"""


def _cells(name: str) -> str:
    return _CELLS.format(t=name, h=repr(HEX), s=repr(HEX * 3**0.5))


@query(f"WITH {_at('population')}, {_hex('population')}, {_cells('population')} SELECT q, r, CAST(coalesce(sum(population), 0) AS BIGINT) AS population FROM hexes LEFT JOIN population_hex USING (q, r) GROUP BY q, r")
def hex_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir, "population")
    return access.hex_sums(p, spatial.hexagons(p, HEX), HEX, "population")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population by rectangles around its points."""
    p = points(spark, sf_dir, "population").withColumns({"w": 30.0 + F.col("id") % 11 * 12.5, "h": 25.0 + F.col("id") % 7 * 20.0})
    corner = lambda i, j: F.struct((F.col("x") + i * F.col("w")).alias("x"), (F.col("y") + j * F.col("h")).alias("y"))
    return p.select("id", "population", F.array(*(corner(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)))).alias("ring"))


_AREAS = f"{_at('population')}, areas AS (SELECT id, population, x - (30 + id % 11 * 12.5e0) AS x0, x + (30 + id % 11 * 12.5e0) AS x1, y - (25 + id % 7 * 20e0) AS y0, y + (25 + id % 7 * 20e0) AS y1 FROM population_at)"
_WIDE, _TALL = 3**0.5 * HEX, 1.5 * HEX
#: Hexagons around a rectangle, with the breaks of the width that both share along y; between two of them it is linear.
_UNDER = f"""{_AREAS}, near AS (SELECT a.*, r, unnest(range(CAST(floor((x0 - r / 2e0 * {_WIDE!r}e0) / {_WIDE!r}e0) AS BIGINT) - 1, CAST(ceil((x1 - r / 2e0 * {_WIDE!r}e0) / {_WIDE!r}e0) AS BIGINT) + 2)) AS q
 FROM (SELECT *, unnest(range(CAST(floor((y0 - {HEX}) / {_TALL!r}e0) AS BIGINT) - 1, CAST(ceil((y1 + {HEX}) / {_TALL!r}e0) AS BIGINT) + 2)) AS r FROM areas) a),
placed AS (SELECT *, {_WIDE!r}e0 * (q + r / 2e0) AS cx, {_TALL!r}e0 * r AS cy, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, (x1 - x0) / 2 AS w, (y1 - y0) / 2 AS h FROM near),
touching AS (SELECT * FROM placed WHERE abs(cx - mx) <= w + {_WIDE / 2!r}e0 AND abs(cy - my) <= h + {HEX}
 AND abs((cx - mx) + (cy - my) * {3**0.5!r}e0) / 2 <= (w + h * {3**0.5!r}e0) / 2 + {_WIDE / 2!r}e0 AND abs((cx - mx) - (cy - my) * {3**0.5!r}e0) / 2 <= (w + h * {3**0.5!r}e0) / 2 + {_WIDE / 2!r}e0)"""


@query(f"WITH {_UNDER} SELECT q, r, CAST(sum(population) AS BIGINT) AS population FROM touching GROUP BY q, r")
def hex_population_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hexagon's sum over the areas that touch it, whole."""
    return overlay.hex_totals(areas(spark, sf_dir), HEX, "population")


_BREAKS = ", ".join(f"cy + {s} * greatest(0, {HEX} - {HEX / 2} * abs({x} - cx) / {_WIDE / 2!r}e0)" for s in ("1", "(-1)") for x in ("x0", "x1"))
_HALF_WIDTH = f"CASE WHEN abs(y - cy) <= {HEX / 2} THEN {_WIDE / 2!r}e0 ELSE {_WIDE / 2!r}e0 * greatest(0, {HEX} - abs(y - cy)) / {HEX / 2} END"


@query(f"""WITH {_UNDER}, cuts AS (SELECT *, list_sort(list_transform([y0, y1, cy - {HEX}, cy + {HEX}, cy - {HEX / 2}, cy + {HEX / 2}, {_BREAKS}], lambda v: greatest(greatest(y0, cy - {HEX}), least(least(y1, cy + {HEX}), v)))) AS ys FROM touching),
steps AS (SELECT *, unnest(ys) AS y, unnest(range(1, len(ys) + 1)) AS i FROM cuts), widths AS (SELECT *, greatest(0, least(x1, cx + {_HALF_WIDTH}) - greatest(x0, cx - ({_HALF_WIDTH}))) AS wide FROM steps),
parts AS (SELECT id, q, r, population, x0, x1, y0, y1, (y - lag(y) OVER k) * (wide + lag(wide) OVER k) / 2 AS part FROM widths WINDOW k AS (PARTITION BY id, q, r ORDER BY i)),
shares AS (SELECT q, r, population * sum(part) / ((x1 - x0) * (y1 - y0)) AS p, sum(part) AS area FROM parts GROUP BY id, q, r, population, x0, x1, y0, y1)
SELECT q, r, round(sum(p), 4) AS population FROM shares WHERE area > 1e-6 GROUP BY q, r""")
def hex_population_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hexagon's sum over the areas that overlap it, by their share of area."""
    return overlay.hex_totals(areas(spark, sf_dir), HEX, "population", by_area=True).select("q", "r", F.round("population", 4).alias("population"))


@query(f"WITH {_AREAS} SELECT a.id, b.id AS other, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 3) AS area FROM areas a JOIN areas b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def area_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of areas that have a point in common, with the area that they share."""
    a = areas(spark, sf_dir)
    found = overlay.overlaps(a.select("id", "ring"), a.select(F.col("id").alias("other"), F.col("ring").alias("other_ring")), 200.0, F.col("id") < F.col("other"))
    # rounded as the SQL rounds, in doubles: a decimal for each pair costs more than the pair
    return found.select("id", "other", (F.floor(F.col("area") * 1000 + 0.5) / 1000).alias("area"))


@query(f"WITH {_at('population')}, {_at('buildings')}, {_hex('buildings')}, {_cells('population')} SELECT q, r, count(id) AS n FROM hexes LEFT JOIN buildings_hex USING (q, r) GROUP BY q, r")
def hex_building_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.hex_sums(points(spark, sf_dir, "buildings"), spatial.hexagons(points(spark, sf_dir, "population"), HEX), HEX)


@query(f"WITH {_at('accidents')}, {_hex('accidents')} SELECT q, r, count(*) AS n FROM accidents_hex GROUP BY q, r")
def hexbin_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bin_counts(points(spark, sf_dir, "accidents"), HEX)


def _streets_in_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spatial.with_hex(points(spark, sf_dir, "nodes"), HEX).select(F.col("node").alias("u"), "q", "r")
    return stressed(spark, sf_dir).select("u", "lts", "name").join(n, "u")


_HEX_STREETS = f"WITH {STREETS}, {_NODES}, {_hex('nodes')}, s AS (SELECT q, r, lts, name FROM streets JOIN (SELECT node AS u, q, r FROM nodes_hex) USING (u)), c AS (SELECT q, r, lts, count(*) AS n FROM s WHERE lts IS NOT NULL GROUP BY ALL)"


@query(f"{_HEX_STREETS} SELECT q, r, arg_max(lts, n * 10 - lts) AS lts FROM c GROUP BY q, r")
def hex_prevalent_lts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.prevalent_stress(_streets_in_hex(spark, sf_dir), ["q", "r"]).select("q", "r", "lts").filter("lts IS NOT NULL")


@query(f"{_HEX_STREETS} SELECT q, r, bool_or(regexp_matches(lower(name), 'tangenziale|superstrada|strada statale|autostrada|strada a scorrimento veloce') AND NOT regexp_matches(lower(name), 'bici|cicla|ciclo')) AS not_cyclable FROM s GROUP BY q, r")
def hex_not_cyclable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.prevalent_stress(_streets_in_hex(spark, sf_dir), ["q", "r"]).select("q", "r", "not_cyclable")


_RING = [(11.28, 46.465), (11.39, 46.47), (11.36, 46.515), (11.31, 46.49), (11.285, 46.512), (11.28, 46.465)]
_CROSSINGS = " + ".join(f"CASE WHEN (({y0!r}e0 > lat) <> ({y1!r}e0 > lat)) AND lon < ({x1!r}e0 - {x0!r}e0) * (lat - {y0!r}e0) / ({y1!r}e0 - {y0!r}e0) + {x0!r}e0 THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip(_RING, _RING[1:]))
_WKT = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in _RING) + "))"


@query(f"WITH {oracle('accidents')} SELECT kind, count(*) AS n FROM accidents WHERE ({_CROSSINGS}) % 2 = 1 GROUP BY 1")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = spark.createDataFrame([(_WKT,)], "wkt string").select(geo.wkt_points(F.col("wkt")).alias("ring"))
    df = table(spark, sf_dir, "accidents").select("kind", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.in_polygons(df, ring, 0.01).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {x!r}e0, {y!r}e0)' for i, (x, y) in enumerate(_RING))}) t(i, x, y)")
def wkt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(_WKT,)], "wkt string").select(F.posexplode(geo.wkt_points(F.col("wkt"))).alias("i", "p"))
    return df.select("i", "p.x", "p.y")


@query(f"""WITH {_at('accidents')}, c AS (SELECT floor(x / 30e0) AS a, floor(y / 30e0) AS b, count(*) AS n, avg(x) AS x, avg(y) AS y FROM accidents_at GROUP BY 1, 2),
ci AS (SELECT n, x, y, unnest(range(CAST(floor(x / 300e0) AS BIGINT) - 4, CAST(floor(x / 300e0) AS BIGINT) + 6)) AS i FROM c),
cij AS (SELECT n, x, y, i, unnest(range(CAST(floor(y / 300e0) AS BIGINT) - 4, CAST(floor(y / 300e0) AS BIGINT) + 6)) AS j FROM ci),
d AS (SELECT n, i, j, (i * 300e0 - x) ** 2 + (j * 300e0 - y) ** 2 AS d2 FROM cij)
SELECT i, j, round(sum(n * exp(-d2 / 180000e0) / (2 * pi() * 90000e0)), 12) AS density FROM d WHERE d2 <= 810000e0 GROUP BY i, j""")
def kde_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.kernel_density(points(spark, sf_dir, "accidents").select("x", "y"), 300.0, 300.0).withColumn("density", F.round("density", 12))


_UTM_E = 2 * geo._N**0.5 / (1 + geo._N)


@query(f"""WITH {oracle('accidents')}, p AS (SELECT id, radians(lat) AS phi, radians(lon - 9) AS lam FROM accidents), t AS (SELECT id, lam, sinh(atanh(sin(phi)) - {_UTM_E!r}e0 * atanh({_UTM_E!r}e0 * sin(phi))) AS t FROM p),
x AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT id, round({geo._EAST!r}e0 + {geo._K0 * geo._R!r}e0 * (eta + {' + '.join(f'{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, a in enumerate(geo._ALPHA, 1))}), 4) AS east,
 round({geo._K0 * geo._R!r}e0 * (xi + {' + '.join(f'{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, a in enumerate(geo._ALPHA, 1))}), 4) AS north, 0e0 AS d_lon, 0e0 AS d_lat FROM x""")
def utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates and what the way there and back loses, to the ten-millionth of a degree."""
    df = table(spark, sf_dir, "accidents")
    east, north = geo.utm(F.col("lon"), F.col("lat"))
    df = df.withColumns({"east": east, "north": north})
    lon, lat = geo.from_utm(F.col("east"), F.col("north"))
    lost = lambda a, b: F.abs(F.round(a - F.col(b), 7))
    return df.select("id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), lost(lon, "lon").alias("d_lon"), lost(lat, "lat").alias("d_lat"))


@query(f"""WITH {STREETS}, {oracle('nodes')}, e AS (SELECT radians(b.y) AS p1, radians(a.y) AS p0, radians(b.x - a.x) AS d FROM streets s JOIN nodes a ON s.u = a.node JOIN nodes b ON s.v = b.node WHERE s.u <> s.v),
b AS (SELECT degrees(atan2(sin(d) * cos(p1), cos(p0) * sin(p1) - sin(p0) * cos(p1) * cos(d))) + 360 AS angle FROM e), m AS (SELECT angle - 360 * floor(angle / 360) AS bearing FROM b)
SELECT CAST(least(floor(bearing / 12), 29) AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY 1""")
def bearing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes")
    ends = lambda c: n.select(F.col("node").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"))
    e = table(spark, sf_dir, "edges").filter("u <> v").select("u", "v").join(ends("u"), "u").join(ends("v"), "v")
    return stats.histogram(e.withColumn("bearing", geo.bearing(F.col("xu"), F.col("yu"), F.col("xv"), F.col("yv"))), "bearing", 30, 0.0, 360.0)


def _reached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(destinations of each hexagon, all hexagons): a hexagon reaches what it holds."""
    name = F.concat_ws("/", "q", "r").alias("hex")
    cells = spatial.hexagons(points(spark, sf_dir, "population"), HEX).select(name)
    return spatial.with_hex(access.usable(points(spark, sf_dir, "destinations")), HEX).select(name, "id", "type"), cells


_TYPES = ", ".join(f"('{t}', '{c}', {w}, {cw}, [{', '.join(str(sum(access.CURVES[k][:n])) for n in range(len(access.CURVES[k]) + 1))}])" for c, cw, types in access.TAXONOMY for t, w, k in types)
_SCORES = f"""WITH {_at('population')}, {_at('destinations')}, {_hex('destinations')}, {_hex('population')}, {_cells('population')},
tax AS (SELECT * FROM (VALUES {_TYPES}) t(type, category, type_weight, category_weight, points)),
held AS (SELECT q, r, type, count(*) AS n FROM destinations_hex WHERE name IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
scored AS (SELECT h.q || '/' || h.r AS hex, type, category, type_weight, category_weight, coalesce(n, 0) AS n, points[least(coalesce(n, 0), len(points) - 1) + 1] AS score FROM hexes h JOIN tax ON true LEFT JOIN held USING (q, r, type)),
cats AS (SELECT hex, category, category_weight, sum(score * type_weight) / 100 AS score FROM scored GROUP BY ALL),
totals AS (SELECT hex, sum(score * category_weight) / 100 AS total_score FROM cats GROUP BY 1)"""


@query(f"{_SCORES} SELECT hex, type, n, score FROM scored")
def bna_type_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.type_scores(*_reached(spark, sf_dir)).select("hex", "type", "n", "score")


@query(f"{_SCORES} SELECT hex, category, round(score, 6) AS score FROM cats")
def bna_category_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.category_scores(access.type_scores(*_reached(spark, sf_dir))).select("hex", "category", F.round("score", 6).alias("score"))


@query(f"{_SCORES} SELECT hex, round(total_score, 6) AS total_score FROM totals")
def bna_total_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.total_scores(access.type_scores(*_reached(spark, sf_dir))).select("hex", F.round("total_score", 6).alias("total_score"))


@query(f"{_SCORES}, p AS (SELECT q || '/' || r AS hex, sum(population) AS population FROM population_hex GROUP BY 1) SELECT round(sum(total_score * population) / sum(population), 6) AS overall_score FROM totals JOIN p USING (hex)")
def bna_overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = spatial.with_hex(points(spark, sf_dir, "population"), HEX).groupBy(F.concat_ws("/", "q", "r").alias("hex")).agg(F.sum("population").alias("population"))
    return access.overall_score(access.total_scores(access.type_scores(*_reached(spark, sf_dir))), people).select(F.round("overall_score", 6).alias("overall_score"))


@query(f"{_SCORES} SELECT CAST(round_even(round(total_score, 6), 0) AS INTEGER) AS score, count(*) AS n FROM totals GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.score_histogram(access.total_scores(access.type_scores(*_reached(spark, sf_dir))).withColumn("total_score", F.round("total_score", 6)))


@query(f"{_SCORES} SELECT CASE WHEN round(total_score, 6) > 20 THEN 'over 20' WHEN round(total_score, 6) > 10 THEN 'over 10' WHEN round(total_score, 6) > 5 THEN 'over 5' ELSE 'rest' END AS band, count(*) AS n FROM totals GROUP BY 1")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.total_scores(access.type_scores(*_reached(spark, sf_dir))).groupBy(access.score_band(F.round("total_score", 6)).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {oracle('destinations')} SELECT lon, lat, id, type FROM (SELECT *, row_number() OVER (PARTITION BY lon, lat ORDER BY id) AS k FROM destinations) WHERE k = 1")
def destination_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.first_at_place(table(spark, sf_dir, "destinations"), ["id"]).select("lon", "lat", "id", "type")


@query(f"WITH {oracle('destinations')}, tax AS (SELECT DISTINCT type FROM (VALUES {_TYPES}) t(type, category, type_weight, category_weight, points)) SELECT type, count(*) AS n FROM destinations JOIN tax USING (type) GROUP BY 1")
def destinations_of_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.of_taxonomy(spark, table(spark, sf_dir, "destinations").withColumnRenamed("type", "amenity")).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {oracle('destinations')} SELECT type, count(*) AS n FROM destinations WHERE name IS NOT NULL GROUP BY 1")
def destination_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.usable(table(spark, sf_dir, "destinations")).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_at('accidents')}, {_hex('accidents')}, {_at('population')}, {_cells('population')}, c AS (SELECT q, r, count(id) AS n FROM hexes LEFT JOIN accidents_hex USING (q, r) GROUP BY q, r) SELECT q, r, n, CAST(n > (SELECT quantile_cont(n, 0.85) FROM c) AS INTEGER) AS label FROM c")
def risk_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.risk_label(_risk_counts(spark, sf_dir), "n")


def _risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.hex_sums(points(spark, sf_dir, "accidents"), spatial.hexagons(points(spark, sf_dir, "population"), HEX), HEX)


@query(f"WITH {_at('accidents')}, {_hex('accidents')}, {_at('population')}, {_cells('population')}, c AS (SELECT q, r, count(id) AS n FROM hexes LEFT JOIN accidents_hex USING (q, r) GROUP BY q, r), l AS (SELECT CAST(n > (SELECT quantile_cont(n, 0.85) FROM c) AS INTEGER) AS label FROM c) SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE)), 6) AS weight FROM l GROUP BY 1")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.class_weights(risk.risk_label(_risk_counts(spark, sf_dir), "n")).withColumn("weight", F.round("weight", 6))


@query("SELECT CAST(label >= 5 AS INTEGER) AS label, CAST(embedding[1] > 0 AS INTEGER) AS prediction, count(*) AS n FROM embeddings GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("label") >= 5).cast("int").alias("label"), (F.col("embedding")[0] > 0).cast("int").alias("prediction"))
    return risk.confusion(df)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("embedding")[0].cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("label") >= 5).cast("int").alias("label"), (first > 0).cast("int").alias("prediction"), (0.5 + first / (2 * (1 + F.abs(first)))).alias("score"))


_SCORED = "WITH s AS (SELECT CAST(label >= 5 AS INTEGER) AS label, CAST(embedding[1] > 0 AS INTEGER) AS prediction, 0.5e0 + CAST(embedding[1] AS DOUBLE) / (2 * (1 + abs(CAST(embedding[1] AS DOUBLE)))) AS score FROM embeddings)"


@query(f"""{_SCORED}, k AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS said, count(*) FILTER (label = class AND prediction = class) AS hit FROM s, (VALUES (0), (1)) c(class) GROUP BY 1),
r AS (SELECT class, support, CASE WHEN said > 0 THEN CAST(hit AS DOUBLE) / said ELSE 0 END AS p, CASE WHEN support > 0 THEN CAST(hit AS DOUBLE) / support ELSE 0 END AS r FROM k)
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, support FROM r""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.report(_scored(spark, sf_dir))
    return found.select("class", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), F.col("support").cast("long").alias("support"))


@query(f"{_SCORED}, b AS (SELECT floor(score * 1000) / 1000 AS threshold, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY 1) SELECT threshold, round(sum(p) OVER w / CAST(sum(p) OVER () AS DOUBLE), 9) AS tpr, round(sum(q) OVER w / CAST(sum(q) OVER () AS DOUBLE), 9) AS fpr FROM b WINDOW w AS (ORDER BY threshold DESC)")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.roc_points(_scored(spark, sf_dir)).select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query()
def risk_cv_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of the logistic model that the grid search finds best, on the rows it has not seen."""
    df = _risk_table(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in _FEATURES})
    train, test = risk.split(df, "hex")
    train, test = risk.standardised(train, test, features=_FEATURES)
    found = risk.areas(risk.grid_search(train, "logreg").transform(test))
    return spark.createDataFrame([(name, float(value)) for name, value in found.items()], "metric string, value double")


def _risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexagons with buildings, population and destinations as features."""
    df = risk.risk_label(_risk_counts(spark, sf_dir), "n")
    for name in ("buildings", "population", "destinations"):
        df = df.join(spatial.bin_counts(points(spark, sf_dir, name), HEX).withColumnRenamed("n", name), ["q", "r"], "left").fillna(0, [name])
    return stored(df.withColumn("hex", F.concat_ws("/", "q", "r")).select("hex", "buildings", "population", "destinations", "label"), "risk")


_FEATURES = ["buildings", "population", "destinations"]


@query()
def risk_rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _risk_table(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in _FEATURES})
    train, _ = risk.split(df, "hex")
    more = risk.smote(train, _FEATURES, "hex")
    scaled, every = risk.standardised(more, df, features=_FEATURES)
    return risk.with_score(risk.forest(scaled).transform(every)).select("hex", "label", "score", F.col("prediction").cast("int").alias("prediction"))


@query()
def risk_model_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the forest of ``risk_rf_predict``, not of given predictions."""
    return risk.confusion(risk_rf_predict(spark, sf_dir))


@query()
def risk_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.report(risk_rf_predict(spark, sf_dir)).select("class", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query()
def risk_model_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.roc_points(risk_rf_predict(spark, sf_dir))


@query()
def risk_kernel_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of machines with linear, radial and cubic kernels over stratified folds of the resampled rows, each at the usual penalty."""
    df = _risk_table(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in _FEATURES})
    train, test = risk.split(df, "hex")
    return risk.searched_areas(train, test, _FEATURES, "hex", ("smote",), ("svm",), 3, {"svm": {"C": [1], "kernel": ["linear", "rbf", "poly"]}})


@query()
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _risk_table(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in _FEATURES})
    return risk.smote(df, _FEATURES, "hex").groupBy("label").agg(F.count("*").alias("n"), F.count("hex").alias("n_real"))


_EPS = 0.0015
_DBSCAN = f"""WITH RECURSIVE {oracle('accidents')}, places AS MATERIALIZED (SELECT lon AS x, lat AS y, count(*) AS w, row_number() OVER (ORDER BY lon, lat) AS p FROM accidents GROUP BY 1, 2),
boxes AS MATERIALIZED (SELECT *, CAST(floor(x / {_EPS}) AS BIGINT) AS i, CAST(floor(y / {_EPS}) AS BIGINT) AS j FROM places), around AS (SELECT * EXCLUDE (i), unnest([i - 1, i, i + 1]) AS i FROM boxes),
pairs AS MATERIALIZED (SELECT a.p, b.p AS o, b.w, b.x, b.y, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM around a JOIN boxes b ON a.i = b.i AND b.j BETWEEN a.j - 1 AND a.j + 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS}e0 * {_EPS}e0),
cores AS MATERIALIZED (SELECT p FROM pairs GROUP BY p HAVING sum(w) >= 4), links AS MATERIALIZED (SELECT p, o FROM pairs WHERE p IN (SELECT p FROM cores) AND o IN (SELECT p FROM cores)),
lab(p, c) USING KEY (p) AS (SELECT p, p FROM cores UNION SELECT k.o, min(f.c) FROM lab f JOIN links k ON k.p = f.p JOIN recurring.lab r ON r.p = k.o WHERE f.c < r.c GROUP BY k.o),
border AS (SELECT p, arg_min(c, (d2, x, y)) AS c FROM (SELECT pairs.p, c, d2, x, y FROM pairs JOIN lab ON lab.p = pairs.o WHERE pairs.p NOT IN (SELECT p FROM cores)) GROUP BY p),
every AS (SELECT p, c, true AS core FROM lab UNION ALL SELECT p, c, false FROM border), numbers AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT c FROM lab)),
labels AS (SELECT id, coalesce(cluster, -1) AS cluster, coalesce(core, false) AS core FROM accidents JOIN places ON x = lon AND y = lat LEFT JOIN every USING (p) LEFT JOIN numbers USING (c))"""


@query(f"{_DBSCAN} SELECT * FROM labels")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "accidents").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return clusters.dbscan(df, _EPS, 4)


@query(f"{_DBSCAN} SELECT cluster, count(*) AS n FROM labels GROUP BY 1")
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_counts(dbscan(spark, sf_dir))


@query(f"{_DBSCAN} SELECT cluster, count(*) AS n, round(avg(lon), 9) AS x, round(avg(lat), 9) AS y FROM labels JOIN accidents USING (id) WHERE cluster >= 0 GROUP BY 1")
def cluster_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "accidents").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return clusters.cluster_centres(df, dbscan(spark, sf_dir)).select("cluster", "n", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"{_DBSCAN} SELECT round(avg(CASE WHEN cluster < 0 THEN 1e0 ELSE 0e0 END), 9) AS noise_share FROM labels")
def noise_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.noise_share(dbscan(spark, sf_dir)).select(F.round("noise_share", 9).alias("noise_share"))


@query(f"WITH {_at('destinations')}, d AS (SELECT id, x, y FROM destinations_at) SELECT a.id, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 2)[2]), 3) AS distance FROM d a JOIN d b ON a.id <> b.id GROUP BY a.id")
def k_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.k_distance(points(spark, sf_dir, "destinations").select("id", "x", "y")).select("id", F.round("distance", 3).alias("distance"))


@query()
def hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = placed(junctions(spark, sf_dir).filter("lts = 4"), "x", "y")
    return clusters_hierarchical.hdbscan(df, ["x", "y"], "node")


@query()
def optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = placed(junctions(spark, sf_dir).filter("lts = 4"), "x", "y")
    return clusters_hierarchical.optics(df, ["x", "y"], "node")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), F.col("label").alias("cluster"))


_F = "WITH f AS (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, label AS cluster, row_number() OVER () AS p FROM embeddings), c AS (SELECT cluster, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM f GROUP BY 1)"


@query(f"{_F}, s AS (SELECT cluster, ma, mb, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2)) AS s FROM f JOIN c USING (cluster) GROUP BY ALL), w AS (SELECT x.cluster, max((x.s + y.s) / sqrt((x.ma - y.ma) ** 2 + (x.mb - y.mb) ** 2)) AS w FROM s x JOIN s y ON x.cluster <> y.cluster GROUP BY 1) SELECT round(avg(w), 5) AS davies_bouldin FROM w")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.davies_bouldin(_features(spark, sf_dir), ["a", "b"]).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query(f"{_F}, w AS (SELECT avg(a) AS wa, avg(b) AS wb FROM f), i AS (SELECT sum((a - ma) ** 2 + (b - mb) ** 2) AS i FROM f JOIN c USING (cluster)), o AS (SELECT sum(n * ((ma - wa) ** 2 + (mb - wb) ** 2)) AS o, count(*) AS g, sum(n) AS n FROM c, w) SELECT round(o / (g - 1) / (i / (n - g)), 5) AS calinski_harabasz FROM o, i")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.calinski_harabasz(_features(spark, sf_dir), ["a", "b"]).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query(f"{_F}, d AS (SELECT x.p, x.cluster, y.cluster AS o, sum(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS s, count(*) AS n FROM f x JOIN f y ON true GROUP BY ALL), e AS (SELECT p, max(CASE WHEN cluster = o THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE -1 END END) AS a, min(CASE WHEN cluster <> o THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a < 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM e")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.silhouette(_features(spark, sf_dir), ["a", "b"]).select(F.round("silhouette", 5).alias("silhouette"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line from each node to the node 97 on, so that lines make chains."""
    n = points(spark, sf_dir, "nodes").select("node", "x", "y")
    other = n.select(((F.col("node") + 403) % 500).alias("node"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return n.join(other, "node").select(F.col("node").alias("id"), F.array(F.struct("x", "y"), F.struct(F.col("ox").alias("x"), F.col("oy").alias("y"))).alias("line"))


def _line_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(accidents by the junction at a line's start, lines that touch)."""
    lines = stored(_lines(spark, sf_dir), "lines")
    counts = nearest_node(spark, sf_dir).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"))
    values = stored(lines.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "values")
    return values, stored(autocorrelation.touching(lines), "touching")


_MORAN = f"""WITH {_at('accidents')}, {_NODES}, d AS (SELECT id, node, (a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y) AS d2 FROM accidents_at a JOIN (SELECT node, x, y FROM nodes_at) n ON true),
near AS (SELECT id, min(node) AS node FROM d JOIN (SELECT id, min(d2) AS d2 FROM d GROUP BY id) m USING (id) WHERE sqrt(d.d2) = sqrt(m.d2) GROUP BY id),
l AS (SELECT a.node AS id, a.x, a.y, b.x AS ox, b.y AS oy FROM nodes_at a JOIN nodes_at b ON b.node = (a.node + 97) % 500),
v AS (SELECT l.id, CAST(count(near.id) AS DOUBLE) AS y FROM l LEFT JOIN near ON near.node = l.id GROUP BY 1),
ends AS (SELECT id, x, y FROM l UNION SELECT id, ox, oy FROM l), w AS (SELECT DISTINCT a.id AS a, b.id AS b FROM ends a JOIN ends b ON a.x = b.x AND a.y = b.y AND a.id <> b.id),
z AS (SELECT id, y - (SELECT avg(y) FROM v) AS z FROM v), lag AS (SELECT a AS id, avg(z) AS lag FROM w JOIN z ON w.b = z.id GROUP BY 1)"""


@query(f"{_MORAN} SELECT count(*) AS n, round(count(*) / CAST(count(lag.id) AS DOUBLE) * sum(z * coalesce(lag, 0)) / sum(z * z), 6) AS moran_i FROM z LEFT JOIN lag USING (id)")
def global_moran(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autocorrelation.global_moran(*_line_counts(spark, sf_dir)).select("n", F.round("moran_i", 6).alias("moran_i"))


@query(f"""{_MORAN}, k AS (SELECT a, CAST(count(*) AS DOUBLE) AS k FROM w GROUP BY 1), i AS (SELECT count(*) AS n, count(*) / CAST(count(lag.id) AS DOUBLE) * sum(z * coalesce(lag, 0)) / sum(z * z) AS i FROM z LEFT JOIN lag USING (id)),
s1 AS (SELECT sum((1 / x.k + 1 / y.k) ** 2) / 2 AS s1 FROM w JOIN k x ON x.a = w.a JOIN k y ON y.a = w.b), s2 AS (SELECT sum(c * c) AS s2, CAST(count(*) AS DOUBLE) AS s0 FROM (SELECT w.a, 1 + sum(1 / y.k) AS c FROM w JOIN k y ON y.a = w.b GROUP BY 1)),
e AS (SELECT n, i, -1e0 / (n - 1) AS expected, (CAST(n AS DOUBLE) * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (CAST(n AS DOUBLE) * n - 1)) - (1e0 / (n - 1)) ** 2 AS variance FROM i, s1, s2)
SELECT n, round(i, 6) AS moran_i, round(expected, 9) AS expected, round(variance, 9) AS variance, round((i - expected) / sqrt(variance), 5) AS z FROM e""")
def moran_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = autocorrelation.moran_test(*_line_counts(spark, sf_dir))
    return found.select("n", F.round("moran_i", 6).alias("moran_i"), F.round("expected", 9).alias("expected"), F.round("variance", 9).alias("variance"), F.round("z", 5).alias("z"))


_LOCAL_MORAN = f"""{_MORAN.replace('WITH', 'WITH RECURSIVE', 1)}, lab(id, c) USING KEY (id) AS (SELECT DISTINCT a, a FROM w UNION SELECT w.b, min(f.c) FROM lab f JOIN w ON w.a = f.id JOIN recurring.lab r ON r.id = w.b WHERE f.c < r.c GROUP BY w.b),
own AS (SELECT v.id, c, y FROM v JOIN lab USING (id)), m AS (SELECT c, avg(y) AS mean, var_pop(y) AS m2, count(*) AS size FROM own GROUP BY 1), zs AS (SELECT id, c, y - mean AS z, m2, size FROM own JOIN m USING (c)),
lags AS (SELECT w.a AS id, avg(z) AS lag FROM w JOIN zs ON zs.id = w.b GROUP BY 1),
marks AS (SELECT id, c AS component, z, lag, z * lag / m2 * (size - 1) / size AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM zs JOIN lags USING (id) WHERE size >= 3 AND m2 > 0)"""


@query(f"{_LOCAL_MORAN} SELECT id, component, round(z, 6) AS z, round(lag, 6) AS lag, round(local_i, 6) AS local_i, quadrant FROM marks")
def local_moran_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = autocorrelation.local_moran(*_line_counts(spark, sf_dir))
    return found.select("id", "component", *(F.round(c, 6).alias(c) for c in ("z", "lag", "local_i")), "quadrant")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their quadrant, the hexagon of their first junction and the name of its first street."""
    hexes = spatial.with_hex(points(spark, sf_dir, "nodes"), HEX).select(F.col("node").alias("id"), F.concat_ws("/", "q", "r").alias("gap"))
    names = table(spark, sf_dir, "edges").groupBy(F.col("u").alias("id")).agg(F.min_by("name", F.struct("l_orderkey", "l_linenumber", "length")).alias("name"))
    return stored(autocorrelation.local_moran(*_line_counts(spark, sf_dir)).join(hexes, "id").join(names, "id", "left"), "marks")


@query(f"{_LOCAL_MORAN}, {_hex('nodes')}, c4 AS (SELECT q || '/' || r AS gap, quadrant, count(*) AS n FROM marks JOIN nodes_hex ON node = id GROUP BY 1, 2) SELECT gap, arg_max(quadrant, n * 10 - quadrant) AS quadrant FROM c4 GROUP BY 1")
def quadrant_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hexagon."""
    return autocorrelation.quadrant_mode(_marks(spark, sf_dir))


@query(f"{_LOCAL_MORAN} SELECT quadrant, count(DISTINCT component) AS components FROM marks GROUP BY 1")
def components_by_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autocorrelation.components_by_quadrant(_marks(spark, sf_dir))


@query(f"{_LOCAL_MORAN}, {oracle('edges')}, f AS (SELECT u AS id, arg_min(name, (l_orderkey, l_linenumber, length)) AS name FROM edges GROUP BY 1) SELECT DISTINCT quadrant, name FROM marks JOIN f USING (id)")
def names_by_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autocorrelation.names_by_quadrant(_marks(spark, sf_dir))


_TURN = "sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _apart(p: str, q: str, r: str, s: str) -> str:
    return f"{_TURN.format(a=p, b=q, c=r)} * {_TURN.format(a=p, b=q, c=s)} > 0"


@query(f"""WITH {_NODES}, {oracle('edges')}, l AS (SELECT a.node AS id, a.x AS p_x, a.y AS p_y, b.x AS q_x, b.y AS q_y FROM nodes_at a JOIN nodes_at b ON b.node = (a.node + 97) % 500),
s AS (SELECT u, piece, x AS r_x, y AS r_y, x + (piece - 3) * 20e0 AS s_x, y + (piece - 2) * 15e0 AS s_y FROM (SELECT DISTINCT u, v % 7 AS piece FROM edges) JOIN nodes_at ON node = u)
SELECT id, count(*) AS n FROM l, s WHERE least(p_x, q_x) <= greatest(r_x, s_x) AND least(r_x, s_x) <= greatest(p_x, q_x) AND least(p_y, q_y) <= greatest(r_y, s_y) AND least(r_y, s_y) <= greatest(p_y, q_y)
 AND NOT ({_apart('p_', 'q_', 'r_', 's_')} OR {_apart('r_', 's_', 'p_', 'q_')}) GROUP BY id""")
def lines_across_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces of streets each line crosses or touches."""
    lines = autocorrelation.segments(_lines(spark, sf_dir))
    n = points(spark, sf_dir, "nodes").select(F.col("node").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    seg = pieces(table(spark, sf_dir, "edges").select("u", "v").distinct().join(n, "u"))
    return spatial.crossing_segments(lines, seg, 300.0, ["id"], ["u", "piece"]).groupBy("id").agg(F.count("*").alias("n"))


@query()
def moran_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, weights = _line_counts(spark, sf_dir)
    return autocorrelation.significance(autocorrelation.local_moran(values, weights), weights, permutations=999)


@query()
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, weights = _line_counts(spark, sf_dir)
    local = stored(autocorrelation.local_moran(values, weights), "local")
    out = autocorrelation.component_summary(local.join(autocorrelation.significance(local, weights, permutations=999), "id"))
    return out.select("component", F.to_json("counts").alias("counts"), F.to_json("mean_z").alias("mean_z"), "share_significant")


@query(f"""WITH RECURSIVE {oracle('edges')}, roads AS MATERIALIZED (SELECT u, v FROM edges WHERE u <> v AND highway IN ({', '.join(repr(r) for r in lts.MAJOR_ROADS)})), w AS (SELECT u AS a, v AS b FROM roads UNION SELECT v, u FROM roads),
lab(id, c) USING KEY (id) AS (SELECT DISTINCT a, a FROM w UNION SELECT w.b, min(f.c) FROM lab f JOIN w ON w.a = f.id JOIN recurring.lab r ON r.id = w.b WHERE f.c < r.c GROUP BY w.b),
sizes AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS g FROM lab GROUP BY c) SELECT g AS "group", count(*) AS n FROM roads JOIN lab ON lab.id = u JOIN sizes USING (c) GROUP BY 1""")
def legacy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main roads by the part of the network that they are in."""
    return terrain.legacy_network(table(spark, sf_dir, "edges")).groupBy("group").agg(F.count("*").alias("n"))


def _dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = o.select(F.floor(F.col("o_orderkey") / 40).cast("int").alias("row"), (F.col("o_orderkey") % 40).cast("int").alias("col"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") * 3) % 200).cast("double").alias("z"), F.col("o_custkey").alias("tile"))
    return terrain.mosaic(raw)


_MOSAIC = "WITH raw AS (SELECT CAST(o_orderkey // 40 AS INTEGER) AS r, CAST(o_orderkey % 40 AS INTEGER) AS c, CAST((o_custkey * 7 + o_orderkey * 3) % 200 AS DOUBLE) AS z, o_custkey AS tile FROM orders), dem AS (SELECT r, c, arg_min(z, tile) AS z FROM raw GROUP BY r, c)"
_HORN = """, g AS (SELECT o.r, o.c, count(*) AS n, sum(d.z * (d.r - o.r) * (2 - abs(d.c - o.c))) AS dy, sum(d.z * (d.c - o.c) * (2 - abs(d.r - o.r))) AS dx FROM dem o JOIN dem d ON d.r BETWEEN o.r - 1 AND o.r + 1 AND d.c BETWEEN o.c - 1 AND o.c + 1 AND NOT (d.r = o.r AND d.c = o.c) GROUP BY o.r, o.c HAVING count(*) = 8),
slopes AS (SELECT r, c, greatest(0e0, least(100e0, sqrt(dx * dx + dy * dy) / 800e0 * 100)) AS slope FROM g)"""


@query(f"{_MOSAIC} SELECT r AS \"row\", c AS col, z FROM dem")
def raster_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dem(spark, sf_dir)


@query(f"{_MOSAIC}{_HORN} SELECT r AS \"row\", c AS col, round(slope, 6) AS slope FROM slopes")
def raster_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.slopes(_dem(spark, sf_dir), 100.0).select("row", "col", F.round("slope", 6).alias("slope"))


@query(f"""{_MOSAIC}{_HORN}, {oracle('edges')}, e AS (SELECT DISTINCT u || '/' || v AS id, u % 40 * 100e0 + 50 AS x0, v % 30 * 100e0 + 50 AS y0 FROM edges), k AS (SELECT ceil(sqrt(150e0 * 150 + 90e0 * 90) / 25e0) + 1 AS n),
s AS (SELECT id, x0, y0, n, unnest(range(0, CAST(n AS BIGINT) + 1)) AS i FROM e, k), under AS (SELECT DISTINCT id, floor((y0 + 90e0 * i / n) / 100e0) AS r, floor((x0 + 150e0 * i / n) / 100e0) AS c FROM s),
m AS (SELECT id, avg(slope) AS slope FROM under LEFT JOIN slopes USING (r, c) GROUP BY 1)
SELECT id, round(slope, 6) AS slope, CASE WHEN slope < 0 THEN NULL WHEN slope < 3 THEN '0-3: flat' WHEN slope < 5 THEN '3-5: mild' WHEN slope < 8 THEN '5-8: medium' WHEN slope < 10 THEN '8-10: hard' WHEN slope < 20 THEN '10-20: extreme' WHEN slope IS NOT NULL THEN '>20: impossible' END AS slope_class FROM m""")
def edge_mean_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets lie across the raster by their numbers."""
    e = table(spark, sf_dir, "edges").select("u", "v").distinct().withColumns({"id": F.concat_ws("/", "u", "v"), "x0": F.col("u") % 40 * 100.0 + 50, "y0": F.col("v") % 30 * 100.0 + 50})
    e = e.withColumns({"x1": F.col("x0") + 150, "y1": F.col("y0") + 90})
    return terrain.edge_slopes(e, terrain.slopes(_dem(spark, sf_dir), 100.0), 100.0, "id").withColumn("slope", F.round("slope", 6))


@query(f"""{_MOSAIC}{_HORN}, {oracle('edges')}, e AS (SELECT DISTINCT u || '/' || v AS id, u % 40 * 100e0 + 50 AS x0, v % 30 * 100e0 + 50 AS y0, 60e0 + u % 7 * 40 AS dx, 45e0 + v % 5 * 55 AS dy FROM edges),
r AS (SELECT *, unnest(range(CAST(floor(y0 / 100) AS BIGINT), CAST(floor((y0 + dy) / 100) AS BIGINT) + 1)) AS r FROM e), cells AS (SELECT *, unnest(range(CAST(floor(x0 / 100) AS BIGINT), CAST(floor((x0 + dx) / 100) AS BIGINT) + 1)) AS c FROM r),
cut AS (SELECT id, r, c, least(1e0, ((c + 1) * 100e0 - x0) / dx, ((r + 1) * 100e0 - y0) / dy) - greatest(0e0, (c * 100e0 - x0) / dx, (r * 100e0 - y0) / dy) AS part FROM cells),
m AS (SELECT id, sum(slope * part) / sum(part) FILTER (slope IS NOT NULL) AS slope FROM cut LEFT JOIN slopes USING (r, c) WHERE part > 1e-12 GROUP BY 1)
SELECT id, round(slope, 6) AS slope, CASE WHEN slope < 0 THEN NULL WHEN slope < 3 THEN '0-3: flat' WHEN slope < 5 THEN '3-5: mild' WHEN slope < 8 THEN '5-8: medium' WHEN slope < 10 THEN '8-10: hard' WHEN slope < 20 THEN '10-20: extreme' WHEN slope IS NOT NULL THEN '>20: impossible' END AS slope_class FROM m""")
def edge_slope_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets lie across the raster by their numbers; every cell that one crosses counts by its length there. The SQL clips it by each cell."""
    e = table(spark, sf_dir, "edges").select("u", "v").distinct().withColumns({"id": F.concat_ws("/", "u", "v"), "x0": F.col("u") % 40 * 100.0 + 50, "y0": F.col("v") % 30 * 100.0 + 50})
    e = e.withColumns({"x1": F.col("x0") + 60 + F.col("u") % 7 * 40, "y1": F.col("y0") + 45 + F.col("v") % 5 * 55})
    return terrain.slopes_by_length(e, terrain.slopes(_dem(spark, sf_dir), 100.0), 100.0, "id").withColumn("slope", F.round("slope", 6))


@query(f"WITH {oracle('edges')} SELECT DISTINCT name, unnest(string_split(name, ' ')) AS part FROM edges")
def graphml_edge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names as a graph file has them, taken apart."""
    text = F.concat(F.lit("['"), F.replace("name", F.lit(" "), F.lit("', '")), F.lit("']"))
    return table(spark, sf_dir, "edges").select("name").distinct().select("name", F.explode(readers.listed_names(text)).alias("part"))
