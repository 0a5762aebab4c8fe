"""Node partitions, border nodes, overlays and cell indices."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import fixpoint
from .store import cut, replaced


def by_polygons(nodes: DataFrame, predicates: list[Column]) -> DataFrame:
    """(node_id, tile): the first polygon that contains a node, -1 if none."""
    tile = F.lit(-1)
    for i, p in reversed(list(enumerate(predicates))):
        tile = F.when(p, i).otherwise(tile)
    return nodes.select("node_id", tile.alias("tile"))


def tagged(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Edges with the tiles of both ends and kind: 10 across tiles, 0 within one."""
    a, b = tiles.select(F.col("node_id").alias("node_a"), F.col("tile").alias("tile_a")), tiles.select(F.col("node_id").alias("node_b"), F.col("tile").alias("tile_b"))
    return edges.join(a, "node_a").join(b, "node_b").withColumn("kind", F.when(F.col("tile_a") != F.col("tile_b"), 10).otherwise(0))


def border_nodes(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """(node, is_in, is_out): nodes at an edge between tiles, entered or left by it."""
    x = tagged(edges, tiles).where("kind = 10")
    both = x.select(F.col("node_b").alias("node"), F.lit(True).alias("is_in"), F.lit(False).alias("is_out")).union(x.select("node_a", F.lit(False), F.lit(True)))
    return both.groupBy("node").agg(F.max("is_in").alias("is_in"), F.max("is_out").alias("is_out"))


def overlay(edges: DataFrame, tiles: DataFrame, max_range: int = 2**30) -> DataFrame:
    """(tile, node_a, node_b, weight): cliques between entries and exits of each tile; edges across tiles are added by the caller."""
    t = cut(tagged(edges, tiles), "overlay")
    inner = t.where("kind = 0").select("node_a", "node_b", "weight")
    ends = border_nodes(edges, tiles)
    seeds = ends.where("is_in").select(F.col("node").alias("src"), "node", F.lit(0).alias("dist"))
    found = fixpoint(inner, seeds, max_range)
    exits = ends.where("is_out").select("node")
    of = tiles.select(F.col("node_id").alias("src"), "tile")
    return found.join(exits, "node", "left_semi").where("src <> node").join(of, "src").select("tile", F.col("src").alias("node_a"), F.col("node").alias("node_b"), F.col("dist").alias("weight"))


def cell_index(edges: DataFrame, tiles: DataFrame, max_range: int = 2**30) -> DataFrame:
    """(tile, node_a, node_b, weight): from each entry of a tile to all nodes that it reaches inside."""
    inner = tagged(edges, tiles).where("kind = 0").select("node_a", "node_b", "weight")
    seeds = border_nodes(edges, tiles).where("is_in").select(F.col("node").alias("src"), "node", F.lit(0).alias("dist"))
    of = tiles.select(F.col("node_id").alias("src"), "tile")
    return fixpoint(cut(inner, "cell-inner"), seeds, max_range).where("src <> node").join(of, "src").select("tile", F.col("src").alias("node_a"), F.col("node").alias("node_b"), F.col("dist").alias("weight"))


def overlay_search(edges: DataFrame, tiles: DataFrame, cliques: DataFrame, cells: DataFrame, seeds: DataFrame, max_range: int) -> DataFrame:
    """One-to-many over an overlay: all edges of the start tile, cliques and cross edges elsewhere, then the cells' insides."""
    t = cut(tagged(edges, tiles), "overlay-tagged")
    of = tiles.select(F.col("node_id").alias("node"), "tile")
    home = cut(seeds.join(of, "node").select("src", "node", "dist", F.col("tile").alias("home")), "overlay-home")
    local = fixpoint_by(home, t.where("kind = 0"), max_range)
    top = t.where("kind = 10").select("node_a", "node_b", "weight").union(cliques.select("node_a", "node_b", "weight"))
    reached = fixpoint(cut(top, "overlay-top"), local, max_range)
    inside = reached.join(cells, F.col("node") == F.col("node_a")).select("src", F.col("node_b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
    return local.unionByName(reached).unionByName(inside.where(F.col("dist") <= max_range)).groupBy("src", "node").agg(F.min("dist").alias("dist"))


def fixpoint_by(home: DataFrame, inner: DataFrame, max_range: int) -> DataFrame:
    """Search within the start's tile only; edges inside tiles never leave it."""
    return fixpoint(inner.select("node_a", "node_b", "weight"), home.select("src", "node", "dist"), max_range)


def ordering(nodes: DataFrame, *keys) -> DataFrame:
    """(source, target): positions by given sort keys. A physical order for storage; ids stay."""
    return nodes.select(F.col("node_id").alias("source"), (F.row_number().over(Window.orderBy(*keys, "node_id")) - 1).alias("target"))


def bisected(nodes: DataFrame, most: int) -> DataFrame:
    """(node_id, tile): parts of at most ``most`` nodes, by halving the longer side of a part's box at its median; all parts at once.

    Nodes at one point are halved by their ids' hash. Only a row a part is exchanged, so no task holds a part.
    """
    at = cut(nodes.select("node_id", "lon", "lat", F.lit(1).cast("long").alias("tile")), "bisect")
    while True:
        ends = [f(c).alias(f"_{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))]
        mid = [F.percentile_approx(c, 0.5).alias(f"_mid_{c}") for c in ("lon", "lat")]
        big = cut(at.groupBy("tile").agg(F.count("*").alias("_n"), *ends, *mid).where(F.col("_n") > most), "bisect-big")
        if big.isEmpty():
            return at.select("node_id", "tile")
        wide = {c: F.col(f"_max_{c}") - F.col(f"_min_{c}") for c in ("lon", "lat")}
        beyond = lambda c: F.when(F.col(f"_mid_{c}") < F.col(f"_max_{c}"), F.col(c) > F.col(f"_mid_{c}")).otherwise(F.col(c) >= F.col(f"_mid_{c}"))
        side = F.when((wide["lon"] == 0) & (wide["lat"] == 0), F.pmod(F.xxhash64("node_id", "tile"), F.lit(2)) == 1).when(wide["lon"] >= wide["lat"], beyond("lon")).otherwise(beyond("lat"))
        halves = at.join(big, "tile", "left").withColumn("_t", F.when(F.col("_n").isNull(), F.col("tile")).otherwise(F.col("tile") * 2 + side.cast("long")))
        at = replaced(at, cut(halves.select("node_id", "lon", "lat", F.col("_t").alias("tile")), "bisect"))


def inertial_flow(nodes: DataFrame, edges: DataFrame, most: int = 10_000, share: float = 0.25, task: int = 200_000) -> DataFrame:
    """(node_id, tile): cells of at most ``most`` nodes, by repeated minimum cuts along four directions.

    A cut is found by one task, so the nodes are first halved by place into parts of at most ``task``. Each round then cuts all cells that
    are too large at once, a task per cell; sources and sinks are the outer ``share`` of the nodes in a direction, capacities are
    one an edge. The least of the four cuts wins.
    """
    tiles = cut(bisected(nodes, max(task, most)), "flow")
    spots = nodes.select("node_id", "lon", "lat")
    while True:
        big = cut(tiles.groupBy("tile").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tile"), "flow-big")
        if big.isEmpty():
            return tiles
        inner = tagged(edges, tiles).where("kind = 0").groupBy(F.col("tile_a").alias("tile"), F.col("node_a").alias("node_id")).agg(F.collect_list("node_b").alias("to"))
        rows = tiles.join(big, "tile", "left_semi").join(spots, "node_id").join(inner, ["tile", "node_id"], "left").select("tile", "node_id", "lon", "lat", "to")
        split = rows.groupBy("tile").applyInPandas(lambda p: _halve(p, share), "node_id int, tile long")
        tiles = cut(tiles.join(big, "tile", "left_anti").select("node_id", "tile").unionByName(split), "flow")


def _halve(p: pd.DataFrame, share: float) -> pd.DataFrame:
    ids = p["node_id"].tolist()
    place = {n: i for i, n in enumerate(ids)}
    links: list[set] = [set() for _ in ids]
    for i, to in enumerate(p["to"]):
        for m in to if to is not None else ():
            j = place.get(m)
            if j is not None and j != i:
                links[i].add(j)
                links[j].add(i)
    best = None
    for a, b in ((1, 0), (0, 1), (1, 1), (1, -1)):
        order = (a * p["lon"] + b * p["lat"]).to_numpy().argsort(kind="stable")
        k = max(1, int(len(ids) * share))
        value, side = min_cut(links, set(order[:k].tolist()), set(order[-k:].tolist()))
        if best is None or value < best[0]:
            best = value, side
    tile = int(p["tile"].iloc[0])
    return pd.DataFrame({"node_id": ids, "tile": [2 * tile + (i not in best[1]) for i in range(len(ids))]})


def min_cut(links: list[set], sources: set, sinks: set) -> tuple[int, set]:
    """(value, nodes on the source side) by shortest augmenting paths with unit capacities."""
    flow: dict[tuple[int, int], int] = {}
    value = 0
    while True:
        prev = dict.fromkeys(sources)
        queue, end = deque(sorted(sources)), None
        while queue and end is None:
            v = queue.popleft()
            for w in links[v]:
                if w not in prev and flow.get((v, w), 0) < 1:
                    prev[w] = v
                    if w in sinks:
                        end = w
                        break
                    queue.append(w)
        if end is None:
            return value, set(prev)
        value += 1
        while prev[end] is not None:
            v = prev[end]
            flow[v, end] = flow.get((v, end), 0) + 1
            flow[end, v] = flow.get((end, v), 0) - 1
            end = v
