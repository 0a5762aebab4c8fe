"""Profiles: built into a folder of tables, prepared for searches, put together as views, and asked by JSON requests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, roads
from ..operators import components, hierarchy, tiled, tiles
from ..sources import catalogue
from . import matrix as api

#: The weight of an edge by vehicle where the metric is time; by distance it is its length for all.
SPEEDS = {"car": lambda: roads.weight_car(F.col("length"), F.col("maxspeed")), "foot": lambda: roads.weight_foot(F.col("length")), "bike": lambda: roads.weight_bike(F.col("length"))}


def weighed(edges: DataFrame, vehicle: str = "car", metric: str = "fastest", weight: Column | None = None) -> DataFrame:
    """edges with weight: seconds of the vehicle, metres, or any other expression."""
    if weight is None:
        weight = roads.weight_shortest(F.col("length")) if metric == "shortest" else SPEEDS[vehicle]()
    return edges.withColumn("weight", weight)


def build(spark: SparkSession, folder: str, name: str, spec: dict, nodes: DataFrame, edges: DataFrame) -> None:
    """Store the largest connected part of a network as a profile, and its description.

    spec (type, vehicle, metric) comes from catalogue.read_config; nodes (node_id, lon, lat), edges (node_a, node_b, length, maxspeed, ...).
    The description is written last, so a profile that has one is whole.
    """
    vehicle = spec.get("vehicle", catalogue.PROFILE_TYPES[spec["type"]][0])
    heavy = weighed(edges, vehicle, catalogue.METRICS[spec.get("metric", "time")])
    kept = components.largest(components.strong_components(nodes, heavy.select("node_a", "node_b")))
    n, e = components.keep_nodes(nodes, heavy, kept)
    catalogue.store(n, f"{folder}/{name}", "nodes")
    catalogue.store(e, f"{folder}/{name}", "edges")
    catalogue.store_meta(spark, folder, name, {**spec, "vehicle": vehicle, "prepared": []})


def _partition(nodes, edges, have, most):
    return {"tiles": tiles.inertial_flow(nodes, edges, most)}


def _overlay(nodes, edges, have, most):
    t = have("tiles")
    return {"overlay": tiles.overlay(edges, t), "cell_index": tiles.cell_index(edges, t)}


def _skeleton(nodes, edges, have, most):
    return {"skeleton": tiled.skeleton(edges, have("tiles"))}


def _hierarchy(nodes, edges, have, most):
    levels, arcs = hierarchy.contract(nodes, edges)
    return {"levels": levels, "arcs": arcs}


def _tiled_hierarchy(nodes, edges, have, most):
    t = have("tiles")
    levels, arcs = tiled.border_hierarchy(nodes, edges, t)
    return {"tile_levels": levels, "tile_arcs": arcs, "tile_index": tiled.tile_index(levels, arcs, t)}


#: Preparations: what they need first, and what they store.
PREPARATIONS = {"partition": ((), _partition), "overlay": (("partition",), _overlay), "skeleton": (("partition",), _skeleton), "hierarchy": ((), _hierarchy), "tiled_hierarchy": (("partition",), _tiled_hierarchy)}

#: The tables of each view of a profile.
VIEWS = {
    "base": ("nodes", "edges"),
    "hierarchy": ("nodes", "edges", "levels", "arcs"),
    "tiled": ("nodes", "edges", "tiles", "overlay", "cell_index"),
    "skeleton": ("nodes", "tiles", "skeleton"),
    "tiled_hierarchy": ("nodes", "edges", "tiles", "tile_levels", "tile_arcs", "tile_index"),
    "transit": ("nodes", "edges", "stops", "connections", "schedule", "transfers"),
}


def prepare(spark: SparkSession, folder: str, name: str, *what: str, most: int = 10_000) -> list[str]:
    """Compute and store preparations of a profile, after what they need; those that its description names are there already.

    Each is one or more tables beside the profile's; the description is renewed after each, so an interrupted preparation goes on
    where it stopped. Cells have at most ``most`` nodes.
    """
    home = f"{folder}/{name}"
    for one in what:
        needs, make = PREPARATIONS[one]
        prepare(spark, folder, name, *needs, most=most)
        meta = catalogue.load_meta(spark, folder)[name]
        if one in meta["prepared"]:
            continue
        made = make(catalogue.load(spark, home, "nodes"), catalogue.load(spark, home, "edges"), lambda t: catalogue.load(spark, home, t), most)
        for table, rows in made.items():
            catalogue.store(rows, home, table)
        catalogue.store_meta(spark, folder, name, {**meta, "prepared": [*meta["prepared"], one]})
    return catalogue.load_meta(spark, folder)[name]["prepared"]


def view(spark: SparkSession, folder: str, name: str, kind: str = "base") -> dict[str, DataFrame]:
    """The tables that a kind of search reads."""
    return catalogue.load_profile(spark, f"{folder}/{name}", *VIEWS[kind])


def read_request(text: str) -> dict:
    """A matrix request as JSON: sources and destinations as pairs of degrees, profile, and where given metric, max_range, avoid_roads
    and avoid_area, a polygon or multipolygon feature. What doesn't fit is a ValueError that names the field."""
    body = json.loads(text)
    if not isinstance(body, dict):
        raise ValueError("a request is an object")
    out = {"metric": "time", "max_range": api.FAR, "avoid_roads": [], "avoid_area": None} | body
    for field in ("sources", "destinations"):
        points = out.get(field)
        if not isinstance(points, list) or not all(isinstance(p, list) and len(p) == 2 and all(isinstance(v, int | float) for v in p) for p in points):
            raise ValueError(f"{field}: a list of pairs of degrees is needed")
    if not isinstance(out.get("profile"), str):
        raise ValueError("profile: a name such as driving-car is needed")
    if not isinstance(out["max_range"], int) or out["max_range"] < 0:
        raise ValueError("max_range: a number from 0 is needed")
    if out["metric"] not in catalogue.METRICS:
        raise ValueError(f"metric: {out['metric']!r} is unknown")
    api.road_numbers(out["avoid_roads"])
    return out


def area_of(shape: dict, x: Column, y: Column) -> Column:
    """Whether a point lies in a GeoJSON feature; only polygons and multipolygons contain points."""
    shape = shape.get("geometry", shape)
    if shape["type"] == "Polygon":
        return geo.in_polygon(x, y, shape["coordinates"])
    return geo.in_multipolygon(x, y, shape["coordinates"]) if shape["type"] == "MultiPolygon" else F.lit(False)


def answer(spark: SparkSession, folder: str, request: dict) -> DataFrame:
    """(source, target, distance) of a matrix request, by places in its lists; the profile is found by type, vehicle and metric."""
    kind, _, vehicle = request["profile"].partition("-")
    name = catalogue.find_profile({k: {**v, "metric": catalogue.METRICS[v.get("metric", "time")]} for k, v in catalogue.load_meta(spark, folder).items()}, kind, vehicle or None, request["metric"])
    graph = view(spark, folder, name)
    points = lambda rows: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "point_id int, lon double, lat double")
    area = None if request["avoid_area"] is None else area_of(request["avoid_area"], F.col("lon"), F.col("lat"))
    return api.matrix(graph["nodes"], graph["edges"], points(request["sources"]), points(request["destinations"]), request["max_range"], request["avoid_roads"] or None, area)
