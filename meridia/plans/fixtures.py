"""A road graph and a timetable derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES_SQL = """SELECT CAST(c_custkey AS INT) AS node_id,
  CAST(6 AS DOUBLE)+CAST((c_custkey*7919) % 997 AS DOUBLE)/CAST(250 AS DOUBLE) AS lon,
  CAST(49 AS DOUBLE)+CAST((c_custkey*104729) % 991 AS DOUBLE)/CAST(250 AS DOUBLE) AS lat FROM customer"""
EDGES_SQL = """SELECT * FROM (SELECT CAST(o_orderkey AS INT) AS edge_id, CAST(o_custkey AS INT) AS node_a,
  CAST(LEAD(o_custkey) OVER (ORDER BY o_orderkey) AS INT) AS node_b,
  CAST(GREATEST(1, FLOOR(o_totalprice/1000)) AS INT) AS weight, CAST(1 + o_orderkey % 15 AS INT) AS road_type,
  CAST(o_totalprice/100 AS FLOAT) AS length, CAST(30 + 10*(o_orderkey % 9) AS INT) AS maxspeed FROM orders) q
  WHERE node_b IS NOT NULL AND node_a <> node_b"""
LEGS_SQL = """SELECT trip_id, route_id, stop_a, stop_b, departure, CAST(departure + 120 + (trip_id+seq) % 400 AS INT) AS arrival FROM (
  SELECT trip_id, CAST(trip_id % 20 AS INT) AS route_id, seq, stop_id AS stop_a,
    CAST(LEAD(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS INT) AS stop_b,
    CAST(21600 + (trip_id*37) % 50400 + seq*600 AS INT) AS departure FROM (
    SELECT CAST(l_orderkey AS INT) AS trip_id, CAST(l_suppkey AS INT) AS stop_id,
      CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq
    FROM lineitem) s) t WHERE stop_b IS NOT NULL AND stop_a <> stop_b"""
POINTS_SQL = """SELECT CAST(p_partkey AS INT) AS point_id,
  CAST(6 AS DOUBLE)+CAST((p_partkey*7001) % 997 AS DOUBLE)/CAST(240 AS DOUBLE) AS lon,
  CAST(49 AS DOUBLE)+CAST((p_partkey*5003) % 991 AS DOUBLE)/CAST(240 AS DOUBLE) AS lat FROM part"""
SUPPLIERS_SQL = """SELECT CAST(s_suppkey AS INT) AS point_id,
  CAST(6 AS DOUBLE)+CAST((s_suppkey*7907) % 997 AS DOUBLE)/CAST(245 AS DOUBLE) AS lon,
  CAST(49 AS DOUBLE)+CAST((s_suppkey*104723) % 991 AS DOUBLE)/CAST(245 AS DOUBLE) AS lat FROM supplier"""
TILE_SQL = "CAST(FLOOR(lon) AS INT)*10 + CAST(FLOOR(lat) AS INT)"


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql.replace("customer", "{customer}").replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}").replace("FROM part", "FROM {part}").replace("FROM supplier", "FROM {supplier}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, NODES_SQL, "customer")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EDGES_SQL, "orders")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LEGS_SQL, "lineitem")


def legs_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs with the weekday of their order, 1 for Monday."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("int").alias("trip_id"), (F.weekday("o_orderdate") + 1).alias("day"))
    return legs(spark, sf_dir).join(days, "trip_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POINTS_SQL, "part")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SUPPLIERS_SQL, "supplier")


def timetable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures with a connection id made of its key."""
    grouped = legs(spark, sf_dir).groupBy("route_id", "stop_a", "stop_b", "departure").agg(F.min("arrival").alias("arrival"))
    return grouped.withColumn("conn_id", F.struct("route_id", "stop_a", "stop_b"))


def tiles(df: DataFrame) -> DataFrame:
    return df.select("node_id", F.expr(TILE_SQL).alias("tile"))


def with_sql(**parts: str) -> str:
    named = {"rg_nodes": NODES_SQL, "rg_edges": EDGES_SQL, "rg_legs": LEGS_SQL, "rg_points": POINTS_SQL}
    named["tt"] = "SELECT route_id, stop_a, stop_b, departure, MIN(arrival) AS arrival FROM rg_legs GROUP BY ALL"
    named["rg_tiles"] = f"SELECT node_id, {TILE_SQL} AS tile FROM rg_nodes"
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in (named | {k: v for k, v in parts.items() if k[0] != "_"}).items())
