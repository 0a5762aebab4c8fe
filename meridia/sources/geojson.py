"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DEPTH = {"Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(type, coordinates as JSON, properties as JSON) of the features of collections or single features."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.coalesce(F.from_json(F.get_json_object("value", "$.features"), "array<string>"), F.array("value")).alias("f")).select(F.explode("f").alias("f"))
    return parts.select(F.get_json_object("f", "$.geometry.type").alias("type"), F.get_json_object("f", "$.geometry.coordinates").alias("coordinates"), F.coalesce(F.get_json_object("f", "$.properties"), F.lit("{}")).alias("properties"))


def coordinates(json: Column, kind: str) -> Column:
    """Nested arrays of a geometry type."""
    return F.from_json(json, _DEPTH[kind])


def feature(kind: str, coords: Column, **properties: Column) -> Column:
    """JSON of one feature."""
    if kind not in _DEPTH:
        raise ValueError(f"unknown geometry type {kind}")
    props = F.struct(*(v.alias(k) for k, v in properties.items())) if properties else F.from_json(F.lit("{}"), "map<string,string>")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry"), props.alias("properties")))


def write_features(features: DataFrame, column: str, path: str) -> None:
    """One feature a line, so that the file can be split."""
    features.select(column).write.text(path)


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """(source, row): a JSON array of each source's distances in order of targets, -1 where there is none."""
    return matrix.groupBy("source").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("target", "distance"))), lambda x: x["distance"])).alias("row"))


def collection(features: DataFrame, column: str) -> DataFrame:
    """(value): one FeatureCollection of a result that is small enough for one document, such as a route; larger ones are written by lines."""
    listed = features.agg(F.array_sort(F.collect_list(column)).alias("f"))
    return listed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}")).alias("value"))


def route_features(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, feature): a LineString of each edge of a path, in its order, with the property value 0.

    steps (seq, edge_id), edges (edge_id, geom: array of (lon, lat)).
    """
    line = F.transform("geom", lambda p: F.array(p["lon"].cast("double"), p["lat"].cast("double")))
    return steps.join(edges.select("edge_id", "geom"), "edge_id").select("seq", feature("LineString", line, value=F.lit(0)).alias("feature"))


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature): a Point of each node and a LineString of each edge, straight between its ends; write_features stores them."""
    point = lambda s: nodes.select(F.col("node_id").alias(f"node_{s}"), F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias(f"_{s}"))
    lines = edges.join(point("a"), "node_a").join(point("b"), "node_b")
    spots = point("a").select(feature("Point", F.col("_a"), node_id=F.col("node_a")).alias("feature"))
    return spots.unionByName(lines.select(feature("LineString", F.array("_a", "_b"), edge_id=F.col("edge_id"), weight=F.col("weight")).alias("feature")))


def point_features(points: DataFrame) -> DataFrame:
    """(feature): points (lon, lat, weight), as tabular.read_points gives them."""
    return points.select(feature("Point", F.array("lon", "lat"), weight=F.col("weight")).alias("feature"))
