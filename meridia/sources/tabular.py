"""Headed CSV with lenient types, and text tables of tiles, orderings and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMPTY = {"string": "", "boolean": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Columns bound by header name: unknown ones are ignored, rows of another length are dropped, values that don't
    parse become zero, false or empty."""
    lines = spark.read.option("sep", sep).option("header", True).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).csv(path)
    cols = []
    for f in schema.fields:
        raw = F.col(f"`{f.name}`") if f.name in lines.columns else F.lit(None).cast("string")
        kind = f.dataType.simpleString()
        cols.append(F.coalesce(raw if kind == "string" else F.trim(raw).try_cast(f.dataType), F.lit(_EMPTY.get(kind, 0)).cast(f.dataType)).alias(f.name))
    return lines.select(*cols)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, tile): one tile a line; the line's number is the node."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\s+$", ""), "\\s+")).alias("node_id", "tile"))
    return lines.select("node_id", F.col("tile").cast("int").alias("tile"))


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, place): pairs after a line with their number."""
    pair = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).select(pair.alias("p")).where(F.size("p") == 2).select(F.col("p")[0].cast("int").alias("node_id"), F.col("p")[1].cast("int").alias("place"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, weight): three numbers a line."""
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") == 3).select(*(F.col("p")[i].cast("double").alias(n) for i, n in enumerate(("lon", "lat", "weight"))))


def write_tiles(tiles: DataFrame, path: str) -> None:
    tiles.repartitionByRange("node_id").sortWithinPartitions("node_id").select(F.col("tile").cast("string")).write.text(path)


def metis(edges: DataFrame) -> DataFrame:
    """(node, line): neighbours of each node without direction or repeats, ids from 1."""
    both = edges.select("node_a", "node_b").union(edges.select("node_b", "node_a")).where("node_a <> node_b").distinct()
    return both.groupBy(F.col("node_a").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("node_b")), lambda x: x + 1), " ").alias("line"))


def write_metis(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph in METIS form: a line with the numbers of nodes and undirected edges, then a line a node in order of ids, which must run from 0."""
    lines = nodes.select(F.col("node_id").alias("node")).join(metis(edges), "node", "left").select("node", F.coalesce("line", F.lit("")).alias("line"))
    sizes = lines.agg(F.count("*").alias("n"), F.sum(F.size(F.filter(F.split("line", " "), lambda x: x != ""))).alias("m"))
    head = sizes.select(F.lit(-1).alias("node"), F.concat_ws(" ", "n", (F.coalesce("m", F.lit(0)) / 2).cast("long")).alias("line"))
    lines.unionByName(head).repartitionByRange("node").sortWithinPartitions("node").select("line").write.text(path)


def write_ordering(order: DataFrame, path: str) -> None:
    """node and place of order (node_id, place), a line each after a line with their number; read_ordering reads it."""
    lines = order.select("node_id", F.concat_ws(" ", "node_id", "place").alias("line"))
    head = order.agg(F.count("*").cast("string").alias("line")).select(F.lit(-1).alias("node_id"), "line")
    lines.unionByName(head).repartitionByRange("node_id").sortWithinPartitions("node_id").select("line").write.text(path)
