"""Maintenance of graph tables: renumbering, removal, merging, counts and checks of consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but those of gone (edge_id)."""
    return edges.join(gone.select("edge_id"), "edge_id", "left_anti")


def renumber(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph under new node ids; mapping (old, new) must name every node."""
    a, b = (mapping.select(F.col("old").alias(f"node_{x}"), F.col("new").alias(f"_{x}")) for x in "ab")
    moved = nodes.join(mapping, nodes["node_id"] == mapping["old"]).drop("old", "node_id").withColumnRenamed("new", "node_id")
    ends = edges.join(a, "node_a").join(b, "node_b").drop("node_a", "node_b").withColumnsRenamed({"_a": "node_a", "_b": "node_b"})
    return moved.select(*nodes.columns), ends.select(*edges.columns)


def attributes(table: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """An attribute table under new ids."""
    return table.join(mapping, table[key] == mapping["old"]).drop("old", key).withColumnRenamed("new", key).select(*table.columns)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(old, new): the second mapping after the first one."""
    return first.withColumnRenamed("new", "_m").join(second.withColumnRenamed("old", "_m"), "_m").select("old", "new")


def renumber_shortcuts(shortcuts: DataFrame, mapping: DataFrame) -> DataFrame:
    """shortcuts (shortcut_id, place, child, is_edge) with new ids of children that are edges; children that are shortcuts keep theirs."""
    both = shortcuts.join(mapping, F.col("is_edge") & (shortcuts["child"] == mapping["old"]), "left")
    return both.select("shortcut_id", "place", F.coalesce("new", "child").alias("child"), "is_edge")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, forward, backward): numbers of edges that leave and enter a node."""
    ends = edges.select(F.col("node_a").alias("node"), F.lit(1).alias("f"), F.lit(0).alias("b")).union(edges.select("node_b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("f").alias("forward"), F.sum("b").alias("backward"))


def tile_sizes(tiles: DataFrame) -> DataFrame:
    """(tile, nodes)."""
    return tiles.groupBy("tile").agg(F.count("*").alias("nodes"))


def tile_count(tiles: DataFrame) -> int:
    """The greatest tile plus one; 0 without tiles."""
    top = tiles.agg(F.max("tile")).first()[0]
    return 0 if top is None else top + 1


def order_by_tile(tiles: DataFrame) -> DataFrame:
    """(old, new): nodes numbered from 0 by tile and id. A tile's first number comes from the sizes of the tiles before it, so no
    task holds more than a tile."""
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)  # a row a tile
    first = tile_sizes(tiles).select("tile", F.coalesce(F.sum("nodes").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("tile").orderBy("node_id"))
    return tiles.withColumn("_place", place).join(first, "tile").select(F.col("node_id").alias("old"), (F.col("_first") + F.col("_place") - 1).cast("int").alias("new"))


def runs(arcs: DataFrame, key: str) -> DataFrame:
    """arcs with run: how many arcs have the same key, so that a sweep can skip a whole run."""
    return arcs.withColumn("run", F.count("*").over(Window.partitionBy(key)))


def tile_headers(arcs: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, arcs): the number of arcs into each tile, what the tile's header says."""
    heads = tiles.select(F.col("node_id").alias("node_b"), "tile")
    return arcs.join(heads, "node_b").groupBy("tile").agg(F.count("*").alias("arcs"))


def merge_cells(*rasters: DataFrame) -> DataFrame:
    """(x, y, value): rasters put together, the least value of each cell."""
    return reduce(DataFrame.unionByName, (r.select("x", "y", "value") for r in rasters)).groupBy("x", "y").agg(F.min("value").alias("value"))


def other_end(edge_a: Column, edge_b: Column, node: Column) -> Column:
    """The end of an edge that a node isn't; null if it is neither."""
    return F.when(edge_a == node, edge_b).when(edge_b == node, edge_a)


def region_counts(points: DataFrame, regions: dict[str, Column]) -> DataFrame:
    """(region, n): points inside each region, given as predicates; regions may overlap, those without points are left out."""
    inside = F.array_compact(F.array(*(F.when(p, F.lit(k)) for k, p in regions.items())))
    return points.select(F.explode(inside).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


def betweenness(trees: DataFrame, samples: DataFrame, most: int = 64) -> DataFrame:
    """(node, n): on how many sampled paths each node lies; trees (src, node, parent), samples (src, node).

    Paths climb their trees together, a step of all of them a join, up to ``most`` steps.
    """
    up = trees.select("src", "node", "parent")
    at, found = samples.select("src", "node"), samples.select("node")
    for _ in range(most):
        at = at.join(up, ["src", "node"]).where("parent IS NOT NULL").select("src", F.col("parent").alias("node"))
        found = found.unionByName(at.select("node"))
    return found.groupBy("node").agg(F.count("*").alias("n"))


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n) of a base graph: edges without a node at an end, repeated ids, weights below one; no rows if it is sound."""
    ends = edges.select("edge_id", F.explode(F.array("node_a", "node_b")).alias("node_id"))
    return _problems(
        loose_end=ends.join(nodes, "node_id", "left_anti").select("edge_id").distinct(),
        repeated_node=nodes.groupBy("node_id").count().where("count > 1"),
        repeated_edge=edges.groupBy("edge_id").count().where("count > 1"),
        bad_weight=edges.where("weight IS NULL OR weight < 1"),
    )


def check_hierarchy(levels: DataFrame, arcs: DataFrame) -> DataFrame:
    """(problem, n) of a hierarchy: nodes without or with several levels, shortcuts whose halves are missing or don't add up."""
    ends = arcs.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    short = arcs.where("mid IS NOT NULL")
    first = arcs.select("node_a", F.col("node_b").alias("mid"), F.col("weight").alias("w1"))
    second = arcs.select(F.col("node_a").alias("mid"), "node_b", F.col("weight").alias("w2"))
    halves = short.join(first, ["node_a", "mid"], "left").join(second, ["mid", "node_b"], "left")
    return _problems(
        no_level=ends.join(levels, "node", "left_anti"),
        repeated_level=levels.groupBy("node").count().where("count > 1"),
        broken_shortcut=halves.where("w1 IS NULL OR w2 IS NULL OR w1 + w2 > weight"),
    )


def check_tiles(nodes: DataFrame, tiles: DataFrame, tagged: DataFrame) -> DataFrame:
    """(problem, n) of a partition: nodes without a tile, edges whose kind doesn't say whether they cross a border."""
    return _problems(
        no_tile=nodes.join(tiles, "node_id", "left_anti"),
        wrong_kind=tagged.where("(tile_a <> tile_b) <> (kind = 10)"),
    )


def _problems(**found: DataFrame) -> DataFrame:
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, rows in found.items()]
    return reduce(DataFrame.unionByName, counted).where("n > 0")
