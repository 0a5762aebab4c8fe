"""GTFS folders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roads import seconds
from ..operators import transit
from ..operators.store import cut
from .tabular import read_csv

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType()}[k]) for n, k in (x.split(":") for x in text.split())])


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(service_id, day) of each service's weekdays."""
    rows = read_csv(spark, f"{path}/calendar.txt", _schema("service_id:s " + " ".join(f"{d}:i" for d in DAYS)))
    flags = F.explode(F.array(*(F.struct(F.lit(d).alias("day"), F.col(d).alias("runs")) for d in DAYS)))
    return rows.select("service_id", flags.alias("d")).where("d.runs = 1").select("service_id", "d.day")


def stops(spark: SparkSession, path: str, area: Column | None = None) -> DataFrame:
    """(stop_id, root, lon, lat): stops whose root is a stop or station with a place inside the area.

    The root is the stop itself, or its parent; for a boarding area (type 4) the parent's parent. A child whose root is absent or outside
    goes. A stop without a place of its own takes its root's.
    """
    raw = read_csv(spark, f"{path}/stops.txt", _schema("stop_id:s stop_lon:d stop_lat:d parent_station:s location_type:i"))
    own = raw.select("stop_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"), F.when(F.col("parent_station") != "", F.col("parent_station")).alias("parent"), "location_type")
    placed = (F.col("lon") != 0) & (F.col("lat") != 0) & (F.col("location_type") < 2)
    tops = own.where(placed if area is None else placed & area).select(F.col("stop_id").alias("root"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    up = own.select(F.col("stop_id").alias("parent"), F.col("parent").alias("_grand"))
    rooted = own.join(up, "parent", "left").withColumn("root", F.when(F.col("location_type") == 4, F.coalesce("_grand", "parent")).otherwise(F.coalesce("parent", "stop_id")))
    return rooted.join(tops, "root").select("stop_id", "root", F.when(placed, F.col("lon")).otherwise(F.col("_lon")).alias("lon"), F.when(placed, F.col("lat")).otherwise(F.col("_lat")).alias("lat"))


def stop_times(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(trip_id, route_id, service_id, stop_id, seq, arrival, departure) in seconds; only known stops, by their root's id."""
    times = read_csv(spark, f"{path}/stop_times.txt", _schema("trip_id:s arrival_time:s departure_time:s stop_id:s stop_sequence:i"))
    trips = read_csv(spark, f"{path}/trips.txt", _schema("trip_id:s route_id:s service_id:s"))
    at = times.join(known.select("stop_id", "root"), "stop_id").join(trips, "trip_id")
    return at.select("trip_id", "route_id", "service_id", F.col("root").alias("stop_id"), F.col("stop_sequence").alias("seq"), seconds(F.col("arrival_time")).alias("arrival"), seconds(F.col("departure_time")).alias("departure"))


def by_day(spark: SparkSession, path: str, area: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stops, connections, schedule by day) of a folder: trips are dealt to the weekdays on which their service runs.

    stops (stop_id, lon, lat) are the roots that a connection uses; connections (conn_id, route_id, stop_a, stop_b); schedule
    (day, conn_id, stop_a, stop_b, departure, arrival, trip_id). Trips of unknown services have no day and drop out.
    """
    known = stops(spark, path, area)
    legs = transit.trip_legs(stop_times(spark, path, known)).join(calendar(spark, path), "service_id")
    conns = cut(transit.connections(legs), "gtfs-connections")
    used = conns.select(F.col("stop_a").alias("stop_id")).union(conns.select("stop_b")).distinct()
    places = known.where("stop_id = root").select("stop_id", "lon", "lat").join(used, "stop_id", "left_semi")
    return places, conns, transit.schedule(legs, conns, "day")
