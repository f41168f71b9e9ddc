"""Queries on streets and junctions, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import access, lts, terrain
from .adapters import oracle, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lts.edge_stress(table(spark, sf_dir, "edges"))


_STRESS_VALUES = ", ".join(f"('{rule}', {level})" for rule, level in lts.STRESS.items())
_TEXT_VALUES = ", ".join("('{}', '{}', '{}')".format(r, *(t[r].replace("'", "''") for t in (lts.MESSAGES, lts.SHORT_MESSAGES))) for r in lts.STRESS)
#: Common table expressions up to ``streets``: edges with rule, stress, slope class and messages.
STREETS = f"""
{oracle("edges")},
norm AS (SELECT *,
  CASE WHEN oneway THEN 1 ELSE coalesce(list_max(list_transform(string_split(lanes, ';'), lambda x: TRY_CAST(x AS INTEGER))), 2) END AS lanes_assumed,
  CASE WHEN maxspeed IS NULL THEN CASE highway WHEN 'motorway' THEN 130 WHEN 'primary' THEN 90 WHEN 'secondary' THEN 90 ELSE 50 END
       ELSE coalesce(list_max(list_transform(string_split(maxspeed, ';'), lambda x: CASE x WHEN 'national' THEN 90 WHEN 'IT:urban' THEN 50 ELSE TRY_CAST(x AS INTEGER) END)), 50) END AS maxspeed_assumed,
  coalesce(width, CASE highway WHEN 'motorway' THEN 11.25e0 WHEN 'primary' THEN 7e0 WHEN 'secondary' THEN 6e0 ELSE 5e0 END / CASE WHEN oneway AND highway <> 'motorway' THEN 2e0 ELSE 1e0 END) AS width_assumed
 FROM edges),
ruled AS (SELECT *,
  CASE WHEN bicycle = 'no' THEN 'p2' WHEN access = 'no' THEN 'p6' WHEN highway = 'motorway' THEN 'p3' WHEN highway = 'motorway_link' THEN 'p4' WHEN highway = 'proposed' THEN 'p7'
       WHEN footway = 'sidewalk' AND coalesce(bicycle, '') <> 'yes' AND highway IN ('footway', 'path') THEN 'p5'
       WHEN highway = 'cycleway' THEN 's3' WHEN highway = 'path' THEN 's1' WHEN highway = 'footway' AND coalesce(footway, '') <> 'crossing' THEN 's2'
       WHEN cycleway = 'track' THEN 's7' WHEN cycleway = 'opposite_track' THEN 's8'
       WHEN cycleway IN ('crossing', 'lane', 'left', 'opposite', 'opposite_lane', 'right', 'yes') THEN
         CASE WHEN lanes_assumed >= 3 AND maxspeed_assumed <= 55 THEN 'b2' WHEN width_assumed <= 4.1e0 THEN 'b3' WHEN width_assumed <= 4.25e0 THEN 'b4'
              WHEN width_assumed <= 4.5e0 AND maxspeed_assumed <= 40 AND highway = 'residential' THEN 'b5' WHEN maxspeed_assumed > 40 AND maxspeed_assumed <= 50 THEN 'b6'
              WHEN maxspeed_assumed > 50 AND maxspeed_assumed <= 55 THEN 'b7' WHEN maxspeed_assumed > 55 THEN 'b8' WHEN highway <> 'residential' THEN 'b9' ELSE 'b1' END
       WHEN motor_vehicle = 'no' THEN 'm17' WHEN highway = 'pedestrian' THEN 'm13' WHEN highway = 'footway' AND footway = 'crossing' THEN 'm14'
       WHEN highway = 'service' AND service = 'alley' THEN 'm2' WHEN highway = 'track' THEN 'm15'
       WHEN maxspeed_assumed <= 50 AND highway = 'service' AND service = 'parking_aisle' THEN 'm3' WHEN maxspeed_assumed <= 50 AND highway = 'service' AND service = 'driveway' THEN 'm4'
       WHEN maxspeed_assumed <= 35 AND highway = 'service' THEN 'm16' WHEN maxspeed_assumed <= 40 AND highway = 'residential' AND lanes_assumed <= 3 THEN 'm5'
       WHEN maxspeed_assumed <= 40 AND lanes_assumed <= 3 THEN 'm6' WHEN maxspeed_assumed <= 40 AND lanes_assumed <= 5 THEN 'm7' WHEN maxspeed_assumed <= 40 THEN 'm8'
       WHEN maxspeed_assumed <= 50 AND highway = 'residential' AND lanes_assumed < 3 THEN 'm9' WHEN maxspeed_assumed <= 50 AND lanes_assumed <= 3 THEN 'm10'
       WHEN maxspeed_assumed <= 50 THEN 'm11' ELSE 'm12' END AS rule
 FROM norm),
based AS (SELECT r.*, b.level AS base_lts, t.message, t.short_message,
  CASE WHEN slope < 0 THEN NULL WHEN slope < 3 THEN '0-3: flat' WHEN slope < 5 THEN '3-5: mild' WHEN slope < 8 THEN '5-8: medium' WHEN slope < 10 THEN '8-10: hard' WHEN slope < 20 THEN '10-20: extreme' WHEN slope IS NOT NULL THEN '>20: impossible' END AS slope_class
 FROM ruled r LEFT JOIN (VALUES {_STRESS_VALUES}) b(rule, level) USING (rule) LEFT JOIN (VALUES {_TEXT_VALUES}) t(rule, message, short_message) USING (rule)),
streets AS (SELECT *, least(4, base_lts + CASE WHEN context = 'urban' THEN
   CASE slope_class WHEN '5-8: medium' THEN CASE WHEN length >= 500 THEN 1 WHEN length IS NOT NULL THEN 0 END WHEN '8-10: hard' THEN CASE WHEN length >= 500 THEN 2 WHEN length IS NOT NULL THEN 1 END
        WHEN '10-20: extreme' THEN 2 WHEN '>20: impossible' THEN 2 ELSE 0 END
   ELSE CASE WHEN slope_class IN ('8-10: hard', '10-20: extreme', '>20: impossible') THEN CASE WHEN length >= 500 THEN 2 ELSE 1 END ELSE 0 END END) AS lts,
  CASE substr(rule, 1, 1) WHEN 'p' THEN 'not_permitted' WHEN 's' THEN 'separated' WHEN 'b' THEN CASE WHEN parking = 'parallel' THEN 'lane_parking' ELSE 'lane_no_parking' END ELSE 'mixed' END AS path_class
 FROM based)"""
JUNCTIONS = f"""{STREETS}, {oracle("nodes")},
tops AS (SELECT u AS node, max(lts) AS top FROM streets GROUP BY u),
junctions AS (SELECT n.*, CASE WHEN top > 2 AND n.highway = 'traffic_signals' THEN 2 WHEN top <= 2 AND n.highway IN ('traffic_signals', 'stop') THEN 1 ELSE top END AS lts,
  CASE WHEN top IS NULL THEN 'Node not found in edges' WHEN top > 2 AND n.highway = 'traffic_signals' THEN 'LTS 3-4 with traffic signals'
       WHEN top <= 2 AND n.highway IN ('traffic_signals', 'stop') THEN 'LTS 1-2 with traffic signals or stop' ELSE 'Node LTS is max intersecting LTS' END AS message
 FROM nodes n LEFT JOIN tops USING (node))"""


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lts.node_stress(table(spark, sf_dir, "nodes"), stressed(spark, sf_dir))


@query(f"WITH {STREETS} SELECT lts, rule, short_message, count(*) AS n FROM streets GROUP BY ALL")
def lts_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(stressed(spark, sf_dir), "lts", "rule", "short_message")


@query(f"WITH {STREETS} SELECT l_orderkey, l_linenumber, u, v, path_class, rule, base_lts, slope_class, lts FROM streets")
def lts_edge_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stressed(spark, sf_dir).select("l_orderkey", "l_linenumber", "u", "v", "path_class", "rule", "base_lts", "slope_class", "lts")


@query(f"WITH {STREETS} SELECT path_class, count(*) AS n, min(base_lts) AS least, max(base_lts) AS most FROM streets GROUP BY 1")
def lts_split_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stressed(spark, sf_dir).groupBy("path_class").agg(F.count("*").alias("n"), F.min("base_lts").alias("least"), F.max("base_lts").alias("most"))


@query(f"WITH {STREETS} SELECT lanes, oneway, lanes_assumed, count(*) AS n FROM streets GROUP BY ALL")
def lanes_assumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(stressed(spark, sf_dir), "lanes", "oneway", "lanes_assumed")


@query(f"WITH {STREETS} SELECT highway, maxspeed, maxspeed_assumed, count(*) AS n FROM streets GROUP BY ALL")
def maxspeed_assumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(stressed(spark, sf_dir), "highway", "maxspeed", "maxspeed_assumed")


@query(f"WITH {STREETS} SELECT highway, oneway, width_assumed, count(*) AS n FROM streets GROUP BY ALL")
def bike_lane_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(stressed(spark, sf_dir), "highway", "oneway", "width_assumed")


@query(f"WITH {STREETS} SELECT slope_class, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM streets WHERE slope_class IS NOT NULL GROUP BY 1")
def slope_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.class_shares(stressed(spark, sf_dir))


@query(f"WITH {STREETS} SELECT context, slope_class, base_lts, lts, count(*) AS n FROM streets GROUP BY ALL")
def slope_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(stressed(spark, sf_dir), "context", "slope_class", "base_lts", "lts")


@query(f"WITH {JUNCTIONS} SELECT node, lts, message FROM junctions")
def node_lts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junctions(spark, sf_dir).select("node", "lts", "message")


@query(f"WITH {STREETS} SELECT CASE WHEN lts IN (1, 2) THEN 'low' WHEN lts IN (3, 4) THEN 'high' END AS stress, count(*) AS n FROM streets GROUP BY 1")
def stress_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stressed(spark, sf_dir).groupBy(lts.stress_class(F.col("lts")).alias("stress")).agg(F.count("*").alias("n"))


_BARS = f"(regexp_matches(lower(coalesce(name, '')), '{lts.MOTORWAY_WORDS}') AND NOT regexp_matches(lower(coalesce(name, '')), '{lts.CYCLE_WORDS}'))"


@query(f"WITH {STREETS} SELECT CASE WHEN {_BARS} THEN 'not cyclable' WHEN lts BETWEEN 1 AND 4 THEN CAST(lts AS VARCHAR) ELSE 'undefined' END AS display, count(*) AS n FROM streets GROUP BY 1")
def display_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stressed(spark, sf_dir).groupBy(lts.display_class(F.col("name"), F.col("lts")).alias("display")).agg(F.count("*").alias("n"))


@query(f"WITH {STREETS} SELECT DISTINCT rule, message, short_message FROM streets")
def rule_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stressed(spark, sf_dir).select("rule", "message", "short_message").distinct()


@query(f"WITH {STREETS} SELECT highway, count(*) AS n FROM streets WHERE highway IN ({', '.join(repr(r) for r in lts.MAJOR_ROADS)}) GROUP BY 1")
def major_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(lts.major_roads(table(spark, sf_dir, "edges")), "highway")


_SUMMARY = "SELECT count(*) AS n, round(avg(lts), 6) AS mean, median(lts) AS median, round(stddev_pop(lts), 6) AS std FROM {} WHERE lts > 0"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("n", F.round("mean", 6).alias("mean"), F.col("median").cast("double").alias("median"), F.round("std", 6).alias("std"))


@query(f"WITH {STREETS} {_SUMMARY.format('streets')}")
def lts_stats_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lts.stress_summary(stressed(spark, sf_dir)))


@query(f"WITH {JUNCTIONS} {_SUMMARY.format('junctions')}")
def lts_stats_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lts.stress_summary(junctions(spark, sf_dir)))


@query(f"WITH {JUNCTIONS} SELECT lts, count(*) AS n FROM junctions WHERE lts > 0 GROUP BY 1")
def lts_frequency_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lts.stress_counts(junctions(spark, sf_dir))


@query(f"WITH {STREETS} SELECT u, v, l_orderkey, l_linenumber, rule FROM streets WHERE lts = 4")
def high_stress_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stressed(spark, sf_dir).filter("lts = 4").select("u", "v", "l_orderkey", "l_linenumber", "rule")


@query("SELECT c_custkey, replace(trim(string_split(string_split(replace(c_name, '#', ' ') || ' Nord - Bozen, Italy', ',')[1], '-')[1]), ' ', '_') AS city FROM customer")
def city_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" Nord - Bozen, Italy"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", lts.city_name(name).alias("city"))


@query(f"WITH {STREETS}, c AS (SELECT lts, count(*) AS n FROM streets WHERE lts > 0 GROUP BY 1) SELECT round(count(*) * sum(n * CAST(n AS DOUBLE)) / sum(n) - sum(n), 6) AS statistic, count(*) - 1 AS df FROM c")
def chi2_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chi2_uniform(lts.stress_counts(stressed(spark, sf_dir))).select(F.round("statistic", 6).alias("statistic"), "df")


@query(f"WITH {STREETS}, c AS (SELECT lts, count(*) AS n FROM streets WHERE lts > 0 GROUP BY 1) SELECT a.lts AS a, b.lts AS b, round(((a.n - (a.n + b.n) / 2.0e0) ** 2 + (b.n - (a.n + b.n) / 2.0e0) ** 2) / ((a.n + b.n) / 2.0e0), 6) AS statistic FROM c a JOIN c b ON a.lts < b.lts")
def chi2_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chi2_pairwise(lts.stress_counts(stressed(spark, sf_dir)), "lts").select("a", "b", F.round("statistic", 6).alias("statistic"))


@query(f"WITH {STREETS} SELECT highway, cycleway, count(*) AS n FROM streets GROUP BY ALL")
def value_counts_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(table(spark, sf_dir, "edges"), "highway", "cycleway")


@query(f"WITH {oracle('edges')} SELECT * FROM (SELECT 'cycleway' AS \"column\", count(*) FILTER (cycleway IS NULL) AS n_null, count(*) AS n FROM edges UNION ALL SELECT 'width', count(*) FILTER (width IS NULL), count(*) FROM edges UNION ALL SELECT 'lanes', count(*) FILTER (lanes IS NULL), count(*) FROM edges)")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.null_audit(table(spark, sf_dir, "edges").select("cycleway", "width", "lanes"))


@query(f"WITH {STREETS} SELECT count(length) AS n, round(min(length), 6) AS min, round(quantile_cont(length, 0.25), 6) AS p25, round(median(length), 6) AS p50, round(quantile_cont(length, 0.75), 6) AS p75, round(max(length), 6) AS max FROM streets")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.describe(table(spark, sf_dir, "edges"), "length").select("n", *(F.round(c, 6).alias(c) for c in ("min", "p25", "p50", "p75", "max")))


_RANKED = "SELECT {g} count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT *, rank() OVER (PARTITION BY {p} ORDER BY length) + (count(*) OVER (PARTITION BY {p}, length) - 1) / 2.0e0 AS rx, rank() OVER (PARTITION BY {p} ORDER BY slope) + (count(*) OVER (PARTITION BY {p}, slope) - 1) / 2.0e0 AS ry FROM streets WHERE length IS NOT NULL AND slope IS NOT NULL) {e}"


@query(f"WITH {STREETS} " + _RANKED.format(g="", p="1", e=""))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "edges"), "length", "slope").select("n", F.round("rho", 6).alias("rho"))


@query(f"WITH {STREETS} " + _RANKED.format(g="highway,", p="highway", e="GROUP BY highway"))
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "edges"), "length", "slope", "highway").filter((F.col("var_x") >= 0.01) & (F.col("var_y") >= 0.01)).select("highway", "n", F.round("rho", 6).alias("rho"))
