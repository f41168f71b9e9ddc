"""Street networks and points made from the benchmark tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

EDGES = """
SELECT l_orderkey, l_linenumber, l_partkey % 500 AS u, (l_partkey*7 + l_suppkey*13 + l_linenumber) % 500 AS v,
 CASE (l_orderkey+l_linenumber) % 14 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'cycleway' WHEN 5 THEN 'path' WHEN 6 THEN 'footway' WHEN 7 THEN 'service' WHEN 8 THEN 'pedestrian' WHEN 9 THEN 'track' WHEN 10 THEN 'motorway' WHEN 11 THEN 'motorway_link' WHEN 12 THEN 'proposed' ELSE 'unclassified' END AS highway,
 CASE l_suppkey % 20 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS bicycle,
 CASE WHEN l_suppkey % 37 = 5 THEN 'no' END AS access,
 CASE l_partkey % 6 WHEN 0 THEN 'sidewalk' WHEN 1 THEN 'crossing' END AS footway,
 CASE l_partkey % 10 WHEN 0 THEN 'track' WHEN 1 THEN 'lane' WHEN 2 THEN 'opposite_track' WHEN 3 THEN 'opposite_lane' END AS cycleway,
 CASE WHEN l_linenumber <= 2 THEN 'parallel' END AS parking,
 CASE l_partkey % 5 WHEN 0 THEN 'alley' WHEN 1 THEN 'parking_aisle' WHEN 2 THEN 'driveway' END AS service,
 CASE WHEN l_suppkey % 41 = 7 THEN 'no' END AS motor_vehicle,
 CASE CAST(FLOOR(l_quantity) AS INT) % 10 WHEN 1 THEN 'national' WHEN 2 THEN 'IT:urban' WHEN 3 THEN '30' WHEN 4 THEN '50;70' WHEN 5 THEN '40' WHEN 6 THEN '50' WHEN 7 THEN '70' WHEN 8 THEN '55' END AS maxspeed,
 CASE l_orderkey % 6 WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '2;4' WHEN 5 THEN '6' END AS lanes,
 l_returnflag = 'R' AS oneway,
 CASE WHEN l_tax >= 0.03e0 THEN ROUND(4.0e0 + l_tax*7, 2) END AS width,
 l_extendedprice/100e0 AS length, ROUND(l_discount*250, 1) AS slope,
 CASE WHEN l_linestatus = 'O' THEN 'urban' ELSE 'countryside' END AS context,
 CASE l_suppkey % 11 WHEN 0 THEN 'Ponte ' WHEN 1 THEN 'Tangenziale ' WHEN 2 THEN 'Strada Statale ciclo ' ELSE 'Via ' END || CAST(l_partkey % 50 AS VARCHAR(8)) AS name
FROM {lineitem}
"""
NODES = """
SELECT node, 11.27e0 + (node % 97)*0.13e0/97 AS x, 46.46e0 + (node % 89)*0.06e0/89 AS y,
 CASE node % 7 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'stop' WHEN 2 THEN 'crossing' END AS highway
FROM (SELECT l_partkey % 500 AS node FROM {lineitem} UNION SELECT (l_partkey*7 + l_suppkey*13 + l_linenumber) % 500 FROM {lineitem}) n
"""
ACCIDENTS = """
SELECT event_id AS id, CAST(2014 + event_id % 11 AS INT) AS anno, event_type AS kind,
 11.27e0 + ((user_id*31 + event_id) % 1300)*1e-4 AS lon, 46.46e0 + ((user_id*17 + event_id*7) % 600)*1e-4 AS lat
FROM {events}
"""
DESTINATIONS = """
SELECT p_partkey AS id, CASE WHEN p_size % 9 <> 0 THEN p_name END AS name,
 CASE p_partkey % 21 WHEN 0 THEN 'school' WHEN 1 THEN 'library' WHEN 2 THEN 'kindergarten' WHEN 3 THEN 'university' WHEN 4 THEN 'doctors' WHEN 5 THEN 'dentist' WHEN 6 THEN 'hospital' WHEN 7 THEN 'pharmacy' WHEN 8 THEN 'supermarket' WHEN 9 THEN 'retail' WHEN 10 THEN 'shop' WHEN 11 THEN 'mall' WHEN 12 THEN 'train_station' WHEN 13 THEN 'bus_station' WHEN 14 THEN 'bus_stop' WHEN 15 THEN 'park' WHEN 16 THEN 'fitness_centre' WHEN 17 THEN 'sports_centre' WHEN 18 THEN 'restaurant' WHEN 19 THEN 'bar' ELSE 'cafe' END AS type,
 11.27e0 + ((p_partkey*37) % 1300)*1e-4 AS lon, 46.46e0 + ((p_partkey*53) % 600)*1e-4 AS lat
FROM {part}
"""
BUILDINGS = """
SELECT o_orderkey AS id, 11.27e0 + ((o_orderkey*41 + o_custkey) % 13000)*1e-5 AS lon,
 46.46e0 + ((o_orderkey*29 + o_custkey*3) % 6000)*1e-5 AS lat
FROM {orders}
"""
POPULATION = """
SELECT c_custkey AS id, 11.27e0 + ((c_custkey*61) % 1300)*1e-4 AS lon, 46.46e0 + ((c_custkey*43) % 600)*1e-4 AS lat,
 CAST(FLOOR(GREATEST(c_acctbal, 0)) AS INT) AS population
FROM {customer}
"""
_SOURCES = {"edges": (EDGES, "lineitem"), "nodes": (NODES, "lineitem"), "accidents": (ACCIDENTS, "events"), "destinations": (DESTINATIONS, "part"), "buildings": (BUILDINGS, "orders"), "population": (POPULATION, "customer")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    sql, source = _SOURCES[name]
    return spark.sql(sql, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def oracle(name: str) -> str:
    """The adapter as a common table expression for DuckDB."""
    sql, source = _SOURCES[name]
    return f"{name} AS ({sql.replace('{' + source + '}', source).strip()})"
