"""Timetable operators: connections and schedules of trips, departures, and time-window searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut


def trip_legs(stop_times: DataFrame) -> DataFrame:
    """(trip_id, route_id, service_id?, stop_a, stop_b, departure, arrival) of consecutive stops of each trip.

    stop_times (trip_id, route_id, stop_id, seq, arrival, departure, ...).
    """
    w = Window.partitionBy("trip_id").orderBy("seq")
    legs = stop_times.withColumn("stop_b", F.lead("stop_id").over(w)).withColumn("_arr", F.lead("arrival").over(w))
    return legs.where("stop_b IS NOT NULL AND stop_b <> stop_id").drop("arrival").withColumnsRenamed({"stop_id": "stop_a", "_arr": "arrival"}).drop("seq")


def connections(legs: DataFrame) -> DataFrame:
    """(conn_id, route_id, stop_a, stop_b): distinct; ids by rank.

    The rank is made of counts per first stop and a row number within it, so no task holds all connections.
    """
    keys = legs.select("route_id", "stop_a", "stop_b").distinct()
    before = Window.orderBy("stop_a").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stop
    base = keys.groupBy("stop_a").agg(F.count("*").alias("n")).select("stop_a", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("stop_a").orderBy("stop_b", "route_id"))
    return keys.withColumn("_p", place).join(base, "stop_a").select((F.col("base") + F.col("_p") - 1).cast("int").alias("conn_id"), "route_id", "stop_a", "stop_b")


def schedule(legs: DataFrame, conns: DataFrame, *by: str) -> DataFrame:
    """(conn_id, departure, arrival, *by): the least arrival of each departure, sorted within a connection."""
    joined = legs.join(conns, ["route_id", "stop_a", "stop_b"])
    return joined.groupBy(*by, "conn_id", "stop_a", "stop_b", "departure").agg(F.min("arrival").alias("arrival"), F.min("trip_id").alias("trip_id")).sortWithinPartitions("conn_id", "departure")


def next_departure(requests: DataFrame, timetable: DataFrame) -> DataFrame:
    """requests (conn_id, asked, ...) with the first departure at or after ``asked`` and its arrival; ties go to the least arrival."""
    keys = requests.columns
    hit = requests.join(timetable.select("conn_id", "departure", "arrival"), "conn_id").where("departure >= asked")
    return hit.groupBy(*keys).agg(F.min(F.struct("departure", "arrival")).alias("n")).select(*keys, "n.departure", "n.arrival")


def departures_between(timetable: DataFrame, start: int, end: int) -> DataFrame:
    """Departures in a closed window; the predicate reaches the scan."""
    return timetable.where(F.col("departure").between(start, end))


def pareto(labels: DataFrame) -> DataFrame:
    """Labels (src, stop, time, departure) that no other label beats by an earlier or equal time and a later or equal departure."""
    w = Window.partitionBy("src", "stop").orderBy("time", F.desc("departure")).rowsBetween(Window.unboundedPreceding, -1)
    return labels.distinct().withColumn("_m", F.max("departure").over(w)).where("_m IS NULL OR _m < departure").drop("_m")


def _ride(front: DataFrame, timetable: DataFrame, transfers: DataFrame | None) -> DataFrame:
    """Labels after one connection (the next departure of each) and, where given, a transfer."""
    at = front.select("src", F.col("stop").alias("stop_a"), F.col("time").alias("at"), F.col("departure").alias("_d"))
    hit = at.join(timetable.select("conn_id", "stop_a", "stop_b", F.col("departure").alias("_dep"), "arrival"), "stop_a").where("_dep >= at")
    ride = hit.groupBy("src", "conn_id", "stop_b", "at", "_d").agg(F.min(F.struct("_dep", "arrival")).alias("n")).select("src", F.col("stop_b").alias("stop"), F.col("n.arrival").alias("time"), F.col("_d").alias("departure"))
    if transfers is None:
        return ride
    walk = ride.join(transfers, ride["stop"] == transfers["stop_a"]).select("src", F.col("stop_b").alias("stop"), (F.col("time") + F.col("weight")).alias("time"), "departure")
    return ride.unionByName(walk)


def earliest_arrival(timetable: DataFrame, starts: DataFrame, departure: int, max_range: int, transfers: DataFrame | None = None) -> DataFrame:
    """(src, stop, time): earliest arrival at each stop when leaving at ``departure``; starts (src, stop)."""
    best = cut(starts.select("src", "stop", F.lit(departure).alias("time")), "arrive")
    front = best
    usable = departures_between(timetable, departure, departure + max_range)
    while not front.isEmpty():
        cand = _ride(front.withColumn("departure", F.lit(departure)), usable, transfers).where(F.col("time") <= departure + max_range).groupBy("src", "stop").agg(F.min("time").alias("time"))
        front = cut(cand.join(best.withColumnRenamed("time", "_old"), ["src", "stop"], "left").where("_old IS NULL OR time < _old").select("src", "stop", "time"), "arrive-front")
        best = cut(best.unionByName(front).groupBy("src", "stop").agg(F.min("time").alias("time")), "arrive")
    return best


def window_search(timetable: DataFrame, starts: DataFrame, start: int, end: int, max_range: int, transfers: DataFrame | None = None) -> DataFrame:
    """(src, stop, duration): least time from leaving to arriving, for departures within [start, end].

    starts (src, stop, walk): walking time to a stop. Labels are pairs of time and departure; each round rides the next departures
    of the frontier's labels, drops what is over max_range and keeps the Pareto front per (src, stop).
    """
    walked = starts.select("src", "stop", (F.lit(end) + F.col("walk")).alias("time"), F.lit(end).alias("departure"))
    usable = departures_between(timetable, start, end + max_range)
    boarding = starts.join(usable, starts["stop"] == usable["stop_a"]).where((F.col("departure") >= start + F.col("walk")) & (F.col("departure") <= end + F.col("walk")))
    boarded = boarding.select("src", "stop", F.col("departure").alias("time"), (F.col("departure") - F.col("walk")).alias("departure"))
    best = cut(pareto(walked.unionByName(boarded)), "labels")
    front = best
    while not front.isEmpty():
        cand = _ride(front, usable, transfers).where(F.col("time") - F.col("departure") <= max_range)
        new = cut(pareto(best.unionByName(cand)), "labels")
        front = cut(new.join(best, ["src", "stop", "time", "departure"], "left_anti"), "labels-front")
        best = new
    return best.groupBy("src", "stop").agg(F.min(F.col("time") - F.col("departure")).alias("duration"))


def transfers(stop_nodes: DataFrame, distances: DataFrame) -> DataFrame:
    """(stop_a, stop_b, weight) for stops whose nodes reach each other; stop_nodes (stop_id, node_id), -1 for none."""
    on = stop_nodes.where("node_id >= 0")
    a, b = on.select(F.col("stop_id").alias("stop_a"), F.col("node_id").alias("src")), on.select(F.col("stop_id").alias("stop_b"), F.col("node_id").alias("node"))
    return distances.join(a, "src").join(b, "node").where("stop_a <> stop_b").groupBy("stop_a", "stop_b").agg(F.min("dist").alias("weight"))


def stop_nodes(snapped: DataFrame) -> DataFrame:
    """(node_id, stop_id): the last stop of each node."""
    return snapped.where("node_id >= 0").groupBy("node_id").agg(F.max("stop_id").alias("stop_id"))
