"""Shortest-path searches as fixpoints of join and grouped minimum, for any number of sources at once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .store import cut, replaced


def fixpoint(edges: DataFrame, seeds: DataFrame, max_range: int, rounds: int | None = None) -> DataFrame:
    """(src, node, dist): least cost from each source's seeds to every node within max_range (inclusive).

    edges (node_a, node_b, weight >= 1), seeds (src, node, dist). The edges are written once, so rounds don't compute them again. Each
    round joins the fresh labels with the edges, keeps candidates within range, and takes the least per (src, node) of these and the labels so
    far with a map-side partial; a label that became smaller is fresh. That is one shuffle of labels and one table a round. The
    range predicate stands before the shuffle. Distances fall strictly, so it ends when no label is fresh.
    """
    edges = cut(edges.select("node_a", "node_b", "weight"), "edges")
    first = seeds.where(F.col("dist") <= max_range).groupBy("src", "node").agg(F.min("dist").alias("dist"))
    best, done = cut(first.withColumn("fresh", F.lit(True)), "best"), 0
    while (rounds is None or done < rounds) and not (front := best.where("fresh")).isEmpty():
        step = front.join(edges, front["node"] == edges["node_a"]).select("src", F.col("node_b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        both = best.withColumn("fresh", F.lit(False)).unionByName(step.where(F.col("dist") <= max_range).withColumn("fresh", F.lit(True)))
        label = both.groupBy("src", "node").agg(F.min(F.struct("dist", "fresh")).alias("label"))  # at equal costs the old label, which isn't fresh
        best = replaced(best, cut(label.select("src", "node", "label.dist", "label.fresh"), "best"))
        done += 1
    return best.select("src", "node", "dist")


def seeds_of(sources: DataFrame) -> DataFrame:
    """One source per node: (node_id) or (node_id, init) as seeds."""
    init = F.col("init") if "init" in sources.columns else F.lit(0)
    return sources.select(F.col("node_id").alias("src"), F.col("node_id").alias("node"), init.cast("int").alias("dist"))


def backward(edges: DataFrame) -> DataFrame:
    """The same edges, searched against their direction."""
    return edges.select(*(F.col(c).alias({"node_a": "node_b", "node_b": "node_a"}.get(c, c)) for c in edges.columns))


def avoid(edges: DataFrame, roads: list[int] | None = None, area: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Edges without road types of a list and without heads in an area; filtered once, before any search.

    area is a predicate on nodes (node_id, lon, lat).
    """
    out = edges if not roads else edges.where(~F.col("road_type").isin(roads))
    if area is not None:
        inside = nodes.where(area).select(F.col("node_id").alias("node_b"))
        out = out.join(inside, "node_b", "left_anti")
    return out


def outside(seeds: DataFrame, area: Column, nodes: DataFrame) -> DataFrame:
    """Seeds that don't lie in an area."""
    return seeds.join(nodes.where(area).select(F.col("node_id").alias("node")), "node", "left_anti").select("src", "node", "dist")


def line_graph(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Edge-based graph: node_a and node_b are edges, the weight is the turn's cost (0 if none) and the second edge's weight."""
    a = edges.select(F.col("edge_id").alias("node_a"), F.col("node_b").alias("via"))
    b = edges.select(F.col("edge_id").alias("node_b"), F.col("node_a").alias("via"), "weight")
    t = turns.select(F.col("from_edge").alias("node_a"), F.col("to_edge").alias("node_b"), "cost")
    return a.join(b, "via").join(t, ["node_a", "node_b"], "left").select("node_a", "node_b", (F.col("weight") + F.coalesce("cost", F.lit(0))).alias("weight"))


def with_turns(edges: DataFrame, turns: DataFrame, seeds: DataFrame, max_range: int) -> DataFrame:
    """Search with turn costs: labels on edges; a node's is the least of its in-edges, a start's its own."""
    start = seeds.join(edges, seeds["node"] == edges["node_a"]).select("src", F.col("edge_id").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
    labels = fixpoint(line_graph(edges, turns), start, max_range)
    ends = edges.select(F.col("edge_id").alias("node"), F.col("node_b").alias("head"))
    reached = labels.join(ends, "node").groupBy("src", F.col("head").alias("node")).agg(F.min("dist").alias("dist"))
    return reached.join(seeds, ["src", "node"], "left_anti").unionByName(seeds.where(F.col("dist") <= max_range))


def nearest(edges: DataFrame, sources: DataFrame, max_range: int) -> DataFrame:
    """(node, src, dist): the nearest source of each node; ties go to the smaller source. One label a node, not one a pair."""
    edges = cut(edges.select("node_a", "node_b", "weight"), "edges")
    best = cut(sources.select(F.col("node_id").alias("node"), F.lit(0).alias("dist"), F.col("node_id").alias("src"), F.lit(True).alias("fresh")).distinct(), "near")
    while not (front := best.where("fresh")).isEmpty():
        step = front.join(edges, front["node"] == edges["node_a"]).select(F.col("node_b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), "src")
        both = best.withColumn("fresh", F.lit(False)).unionByName(step.where(F.col("dist") <= max_range).withColumn("fresh", F.lit(True)))
        label = both.groupBy("node").agg(F.min(F.struct("dist", "src", "fresh")).alias("label"))
        best = replaced(best, cut(label.select("node", "label.dist", "label.src", "label.fresh"), "near"))
    return best.select("node", "src", "dist")


def k_nearest(edges: DataFrame, sources: DataFrame, k: int, max_range: int) -> DataFrame:
    """(node, src, dist, rank): the k nearest sources of each node, ties by source; a label leaves the search once k are better."""
    edges = cut(edges.select("node_a", "node_b", "weight"), "edges")
    top = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("dist", "src"))).where(F.col("rank") <= k)
    best = cut(top(seeds_of(sources)), "knear")
    front = best.drop("rank")
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["node_a"]).select("src", F.col("node_b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        cand = step.where(F.col("dist") <= max_range).groupBy("src", "node").agg(F.min("dist").alias("dist"))
        both = best.drop("rank").unionByName(cand).groupBy("src", "node").agg(F.min("dist").alias("dist"))
        new = cut(top(both), "knear")
        front = cut(new.join(best, ["src", "node", "dist"], "left_anti").select("src", "node", "dist"), "knear-front")
        best = new
    return best.select("node", "src", "dist", "rank")


def tree(edges: DataFrame, best: DataFrame) -> DataFrame:
    """(src, node, dist, edge_id, parent): for each node the least edge that realises its distance."""
    a = best.select("src", F.col("node").alias("parent"), F.col("dist").alias("_d"))
    via = a.join(edges, a["parent"] == edges["node_a"]).select("src", F.col("node_b").alias("node"), (F.col("_d") + F.col("weight")).alias("dist"), "edge_id", "parent")
    pick = via.join(best, ["src", "node", "dist"]).groupBy("src", "node", "dist").agg(F.min(F.struct("edge_id", "parent")).alias("p"))
    return best.join(pick, ["src", "node", "dist"], "left").select("src", "node", "dist", "p.edge_id", "p.parent")


def edge_values(edges: DataFrame, best: DataFrame, max_range: int) -> DataFrame:
    """(src, edge_id, start, end): costs at both ends of the edges that leave reached nodes; the end is cut at max_range."""
    on = best.select("src", "node", "dist").join(edges, F.col("node") == F.col("node_a"))
    return on.select("src", "edge_id", F.col("dist").alias("start"), F.least(F.col("dist") + F.col("weight"), F.lit(max_range)).alias("end"))


def path(spanning: DataFrame, source: int, target: int) -> DataFrame:
    """(seq, edge_id, node): the edges of a path, from source to target.

    Pointer doubling over the tree: after k rounds each node knows its ancestor 2 ** k steps up, and nodes on the path are marked by
    joins with the marked ones, so a path of n edges takes about log2 n rounds.
    """
    mine = cut(spanning.where(F.col("src") == source).select("node", "edge_id", "parent"), "tree")
    jump = mine.select("node", F.col("parent").alias("up"))
    marked = cut(mine.where(F.col("node") == target).select("node", F.lit(0).cast("long").alias("back")), "walk")
    reach = 1
    while True:
        found = marked.join(jump.where("up IS NOT NULL"), "node").select(F.col("up").alias("node"), (F.col("back") + reach).alias("back"))
        if found.isEmpty():
            break
        marked = cut(marked.unionByName(found).groupBy("node").agg(F.min("back").alias("back")), "walk")
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        jump, reach = cut(jump.join(far, "up", "left").select("node", F.col("_next").alias("up")), "jump"), reach * 2
    steps = mine.join(marked, "node").where("edge_id IS NOT NULL")
    n = marked.agg(F.max("back")).first()[0] or 0
    return steps.select((F.lit(n) - F.col("back") - 1).cast("int").alias("seq"), "edge_id", "node")


def route(edges: DataFrame, source: int, target: int, potential: DataFrame | None = None) -> DataFrame:
    """The path's edges. The search stops once the frontier's least label reaches the target's.

    potential (node, bound): a lower bound of the rest to the target; labels that can't beat the best are pruned.
    """
    best = None
    for _, best in steps(edges, source, target, potential):  # noqa: B007
        pass
    return path(tree(edges, best), source, target)


def steps(edges: DataFrame, source: int, target: int, potential: DataFrame | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
    """A stepped search: yields (frontier, labels so far) after each round."""
    spark = edges.sparkSession
    edges = cut(edges.select("node_a", "node_b", "weight"), "edges")
    best = cut(spark.createDataFrame([(source, source, 0)], "src int, node int, dist int"), "best")
    front = best
    while not front.isEmpty():
        row = best.where(F.col("node") == target).agg(F.min("dist")).first()
        bound = row[0] if row[0] is not None else 2**31 - 1
        step = front.join(edges, front["node"] == edges["node_a"]).select("src", F.col("node_b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        if potential is not None:
            step = step.join(potential, "node", "left").where(F.col("dist") + F.coalesce("bound", F.lit(0)) <= bound).drop("bound")
        cand = step.where(F.col("dist") <= bound).groupBy("src", "node").agg(F.min("dist").alias("dist"))
        front = cut(cand.join(best.withColumnRenamed("dist", "_old"), ["src", "node"], "left").where("_old IS NULL OR dist < _old").select("src", "node", "dist"), "front")
        best = cut(best.unionByName(front).groupBy("src", "node").agg(F.min("dist").alias("dist")), "best")
        yield front, best


def meet(forward: DataFrame, back: DataFrame) -> DataFrame:
    """(node, dist): where a forward and a backward search meet at the least sum; ties go to the smaller node."""
    both = forward.select("node", F.col("dist").alias("f")).join(back.select("node", F.col("dist").alias("b")), "node")
    return both.select("node", (F.col("f") + F.col("b")).alias("dist")).orderBy("dist", "node").limit(1)


def straight(nodes: DataFrame, to: int, speed: float = 130.0) -> DataFrame:
    """(node, bound): seconds of the straight line to a node at the top speed in km/h, a lower bound of travel times."""
    end = nodes.where(F.col("node_id") == to).select("lon", "lat").first()
    metres = haversine("lon", "lat", F.lit(end["lon"]), F.lit(end["lat"]))
    return nodes.select(F.col("node_id").alias("node"), F.floor(metres * 3.6 / speed).cast("int").alias("bound"))


def both_ways(edges: DataFrame, source: int, target: int, ahead: DataFrame | None = None, behind: DataFrame | None = None, max_range: int = 2**31 - 2) -> DataFrame:
    """(node, dist): where searches from both ends meet at the least sum; no row if there is no path within max_range (inclusive).

    The side whose frontier has the lesser least label goes on, until the sum of both least labels reaches the best meeting or a
    side is exhausted: labels up to a frontier's least one are final, so no shorter path is left. Labels that reach the best
    meeting are dropped, with lower bounds (node, bound) of the rest to the target (ahead) and from the source (behind) sooner.
    """
    spark, rest = edges.sparkSession, (ahead, behind)
    edges = cut(edges.select("node_a", "node_b", "weight"), "edges")
    seed = lambda n: cut(spark.createDataFrame([(n, n, 0)], "src int, node int, dist int"), "best")
    graphs, best = (edges, backward(edges)), [seed(source), seed(target)]
    front, least = list(best), [0, 0]
    while True:
        row = meet(*best).first()
        bound = min(row["dist"] if row else max_range + 1, max_range + 1)
        if None in least or sum(least) >= bound:
            return meet(*best).where(F.col("dist") <= max_range)
        i = 0 if least[0] <= least[1] else 1
        step = front[i].join(graphs[i], front[i]["node"] == graphs[i]["node_a"]).select("src", F.col("node_b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        if rest[i] is not None:
            step = step.join(rest[i], "node", "left").where(F.col("dist") + F.coalesce("bound", F.lit(0)) < bound).drop("bound")
        cand = step.where(F.col("dist") < bound).groupBy("src", "node").agg(F.min("dist").alias("dist"))
        front[i] = cut(cand.join(best[i].withColumnRenamed("dist", "_old"), ["src", "node"], "left").where("_old IS NULL OR dist < _old").select("src", "node", "dist"), "front")
        best[i] = cut(best[i].unionByName(front[i]).groupBy("src", "node").agg(F.min("dist").alias("dist")), "best")
        least[i] = front[i].agg(F.min("dist")).first()[0]
