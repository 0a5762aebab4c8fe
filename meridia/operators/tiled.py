"""Searches on a graph that is divided into tiles: skeletons, supersteps of whole tiles, and hierarchies swept in the tiles they reach.

Tiles are bounded in size (tiles.inertial_flow), so a task may hold one tile's edges.
"""

from __future__ import annotations

import heapq
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import contract, downward, up_and_down
from .search import fixpoint, path, route, tree
from .store import cut, replaced
from .tiles import border_nodes, tagged


def skeleton(edges: DataFrame, tiles: DataFrame, max_range: int = 2**30) -> DataFrame:
    """Edges with tile_a, tile_b and kind: 10 across tiles, 20 on a shortest path from an entry of a tile to one of its exits, else 0.

    Entries search inside their tiles all at once; marks then climb the trees from the exits, a step of all of them a round, and each
    pair of entry and node is marked once.
    """
    t = cut(tagged(edges, tiles), "skeleton")
    inner = t.where("kind = 0").select("edge_id", "node_a", "node_b", "weight")
    ends = cut(border_nodes(edges, tiles), "skeleton-ends")
    found = fixpoint(inner, ends.where("is_in").select(F.col("node").alias("src"), "node", F.lit(0).alias("dist")), max_range)
    up = cut(tree(inner, found).where("parent IS NOT NULL").select("src", "node", "edge_id", "parent"), "skeleton-tree")
    front = cut(up.join(ends.where("is_out"), "node", "left_semi").select("src", "node", "edge_id", "parent"), "skeleton-front")
    marked = cut(front.select("src", "node", "edge_id"), "skeleton-marked")
    while not front.isEmpty():
        above = front.select("src", F.col("parent").alias("node")).distinct().join(marked, ["src", "node"], "left_anti")
        front = replaced(front, cut(above.join(up, ["src", "node"]), "skeleton-front"))
        marked = replaced(marked, cut(marked.unionByName(front.select("src", "node", "edge_id")), "skeleton-marked"))
    used = marked.select("edge_id", F.lit(20).alias("_k")).distinct()
    return t.join(used, "edge_id", "left").withColumn("kind", F.greatest("kind", F.coalesce("_k", F.lit(0)))).drop("_k")


def around(marked: DataFrame, tiles: DataFrame, homes: DataFrame) -> DataFrame:
    """The skeleton and all edges inside the tiles of homes (node): what a search between these nodes needs."""
    own = tiles.join(homes.select(F.col("node").alias("node_id")), "node_id", "left_semi").select(F.col("tile").alias("tile_a")).distinct()
    return marked.where("kind > 0").unionByName(marked.where("kind = 0").join(own, "tile_a", "left_semi").select(*marked.columns))


def skeleton_route(marked: DataFrame, tiles: DataFrame, source: int, target: int) -> DataFrame:
    """(seq, edge_id, node): a shortest path, found on all edges of both ends' tiles and the skeleton elsewhere."""
    homes = marked.sparkSession.createDataFrame([(source,), (target,)], "node long")
    return route(around(marked, tiles, homes), source, target)


def skeleton_tree(marked: DataFrame, tiles: DataFrame, seeds: DataFrame, max_range: int) -> DataFrame:
    """(src, node, dist, edge_id, parent): search trees of the whole graph within max_range.

    The skeleton and the sources' own tiles are searched first; then only the tiles that were entered, inside.
    """
    top = cut(around(marked, tiles, seeds), "skeleton-top")
    reached = fixpoint(top, seeds, max_range)
    active = reached.join(tiles, F.col("node") == F.col("node_id")).select(F.col("tile").alias("tile_a")).distinct()
    inside = marked.where("kind IN (0, 20)").join(active, "tile_a", "left_semi")
    return tree(marked, fixpoint(inside, reached, max_range))


def tile_supersteps(edges: DataFrame, tiles: DataFrame, source: int, target: int) -> DataFrame:
    """(node, dist): labels of a search whose tiles settle on their own and exchange labels over their borders.

    A superstep gives every tile with new labels to a task that searches the tile's inside; edges across borders then carry what
    changed to other tiles. So there are as many rounds as borders crossed, not edges. The target's best label is the bound of
    all tiles in the next round; labels that reach it are dropped, and the target's own is exact at the end.
    """
    t = cut(tagged(edges, tiles), "steps")
    inner = t.where("kind = 0").select(F.col("tile_a").cast("long").alias("tile"), *(F.col(c).cast("long").alias(c) for c in ("node_a", "node_b", "weight")))
    over = t.where("kind = 10").select("node_a", "node_b", "weight", "tile_b")
    start = tiles.where(F.col("node_id") == source).select(F.col("node_id").cast("long").alias("node"), F.col("tile").cast("long").alias("tile"), F.lit(0).cast("long").alias("dist"))
    best = cut(start.withColumn("fresh", F.lit(True)), "steps-best")
    while not (front := best.where("fresh")).isEmpty():
        row = best.where(F.col("node") == target).agg(F.min("dist")).first()
        bound = 2**62 if row[0] is None else row[0]
        awake = front.select("tile").distinct()
        labels, roads = best.join(awake, "tile", "left_semi"), inner.join(awake, "tile", "left_semi")
        settle = partial(_settle, most=bound)
        moved = cut(labels.groupBy("tile").cogroup(roads.groupBy("tile")).applyInPandas(settle, "node long, tile long, dist long"), "steps-moved")
        sent = moved.join(over, moved["node"] == over["node_a"]).select(F.col("node_b").cast("long").alias("node"), F.col("tile_b").cast("long").alias("tile"), (F.col("dist") + F.col("weight")).alias("dist"))
        sent = sent.where((F.col("dist") < bound) | ((F.col("node") == target) & (F.col("dist") <= bound)))
        old = best.withColumn("fresh", F.lit(False)).unionByName(moved.withColumn("fresh", F.lit(False)))
        label = old.unionByName(sent.withColumn("fresh", F.lit(True))).groupBy("node", "tile").agg(F.min(F.struct("dist", "fresh")).alias("label"))
        best = replaced(best, cut(label.select("node", "tile", "label.dist", "label.fresh"), "steps-best"))
        replaced(moved, best)
    return best.select("node", "dist")


def _settle(labels: pd.DataFrame, edges: pd.DataFrame, *, most: int) -> pd.DataFrame:
    """The labels of one tile that are new or became smaller by its inner edges."""
    if not len(labels):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("node", "tile", "dist")})
    out: dict[int, list] = {}
    for a, b, w in zip(*(edges[c].tolist() for c in ("node_a", "node_b", "weight")), strict=True):
        out.setdefault(a, []).append((b, w))
    known = dict(zip(labels["node"].tolist(), labels["dist"].tolist(), strict=True))
    new = labels[labels["fresh"]]
    changed = dict(zip(new["node"].tolist(), new["dist"].tolist(), strict=True))
    heap = [(d, n) for n, d in changed.items()]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if d > known[n]:
            continue
        for m, w in out.get(n, ()):
            if d + w <= most and d + w < known.get(m, 2**62):
                known[m] = changed[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return pd.DataFrame({"node": list(changed), "tile": labels["tile"].iloc[0], "dist": list(changed.values())}).astype("int64")


def superstep_route(edges: DataFrame, tiles: DataFrame, source: int, target: int) -> DataFrame:
    """(seq, edge_id, node): the path that the supersteps found."""
    found = tile_supersteps(edges, tiles, source, target).select(F.lit(source).cast("long").alias("src"), "node", "dist")
    return path(tree(edges, found), source, target)


def border_hierarchy(nodes: DataFrame, edges: DataFrame, tiles: DataFrame, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """A hierarchy that contracts only nodes inside tiles; border nodes stay in the core, so that shortcuts never leave a tile."""
    return contract(nodes, edges, rounds=rounds, keep=border_nodes(edges, tiles).select("node"))


def tile_index(levels: DataFrame, arcs: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, node_a, node_b, weight, la, lb): downward arcs by the tile of their head; store it partitioned by tile."""
    heads = tiles.select(F.col("node_id").alias("node_b"), "tile")
    return up_and_down(levels, arcs)[1].join(heads, "node_b").select("tile", "node_a", "node_b", "weight", "la", "lb")


def tile_sweep(levels: DataFrame, arcs: DataFrame, index: DataFrame, tiles: DataFrame, seeds: DataFrame, max_range: int) -> DataFrame:
    """(src, node, dist) over a border hierarchy: upward and through the core, then down in those tiles only that were reached."""
    best = fixpoint(up_and_down(levels, arcs)[0], seeds, max_range)
    active = best.join(tiles, F.col("node") == F.col("node_id")).select("tile").distinct()
    return downward(best, cut(index.join(active, "tile", "left_semi"), "tile-down"), max_range)
