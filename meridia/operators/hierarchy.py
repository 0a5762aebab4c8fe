"""Contraction hierarchies by rounds of independent sets, queries on them and level-ordered sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import backward, fixpoint, meet
from .store import cut


def contract(nodes: DataFrame, edges: DataFrame, rounds: int = 20, degree: float = 12.0, keep: DataFrame | None = None, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels (node, level), arcs (node_a, node_b, weight, mid)): all edges and shortcuts; mid is null for edges.

    A round contracts the nodes whose priority (edge difference, then a hash) is least among their neighbours'; such
    nodes are independent, so all are done at once. A shortcut u-v-w is left out if a path of one or two hops that avoids the
    round's nodes is as short. Contraction ends when all nodes are done, after ``rounds``, or when the rest is
    denser than ``degree``; what is left is the core, one level above. Nodes of keep (node) are never contracted. With order
    (node, place) lesser places go first instead of lesser edge differences.
    """
    arcs = cut(edges.where("node_a <> node_b").groupBy("node_a", "node_b").agg(F.min("weight").alias("weight")).withColumn("mid", F.lit(None).cast("int")), "ch-arcs")
    live, left, levels, level = arcs, cut(nodes.select(F.col("node_id").alias("node")), "ch-left"), None, 0
    kept = left.limit(0) if keep is None else cut(left.join(keep.select("node"), "node", "left_semi"), "ch-kept")
    left, aside = cut(left.join(kept, "node", "left_anti"), "ch-left"), kept.count()
    while level < rounds and not left.isEmpty():
        n, m = left.count() + aside, live.count()
        if m > degree * n:
            break
        out_, in_ = live.groupBy(F.col("node_a").alias("node")).agg(F.count("*").alias("o")), live.groupBy(F.col("node_b").alias("node")).agg(F.count("*").alias("i"))
        both = left.join(out_, "node", "left").join(in_, "node", "left").select("node", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
        priority = F.col("o") * F.col("i") - F.col("o") - F.col("i")
        if order is not None:
            both, priority = both.join(order.select("node", "place"), "node", "left"), F.coalesce("place", F.lit(2**31)).cast("long")
        rank = cut(both.select("node", F.struct(priority.alias("p"), F.xxhash64("node").alias("h"), F.col("node").alias("id")).alias("rank")), "ch-rank")
        sides = live.select("node_a", "node_b").union(live.select("node_b", "node_a"))
        beside = sides.join(rank.select(F.col("node").alias("node_b"), F.col("rank").alias("other")), "node_b").groupBy(F.col("node_a").alias("node")).agg(F.min("other").alias("other"))
        pick = cut(rank.join(beside, "node", "left").where("other IS NULL OR rank < other").select("node"), "ch-pick")
        into = live.join(pick, live["node_b"] == pick["node"]).select("node", F.col("node_a").alias("u"), F.col("weight").alias("w1"))
        from_ = live.join(pick, live["node_a"] == pick["node"]).select("node", F.col("node_b").alias("w"), F.col("weight").alias("w2"))
        via = into.join(from_, "node").where("u <> w").groupBy("u", "w").agg(F.min(F.struct((F.col("w1") + F.col("w2")).alias("d"), F.col("node").alias("v"))).alias("s"))
        rest = live.join(pick, live["node_a"] == pick["node"], "left_anti").join(pick, live["node_b"] == pick["node"], "left_anti")
        rest = cut(rest.select("node_a", "node_b", "weight"), "ch-rest")
        one = rest.select(F.col("node_a").alias("u"), F.col("node_b").alias("w"), F.col("weight").alias("d1"))
        hop = rest.select(F.col("node_a").alias("u"), F.col("node_b").alias("x"), F.col("weight").alias("h1")).join(via.select("u", "w"), "u").join(rest.select(F.col("node_a").alias("x"), F.col("node_b").alias("w"), F.col("weight").alias("h2")), ["x", "w"]).groupBy("u", "w").agg(F.min(F.col("h1") + F.col("h2")).alias("d2"))
        need = via.join(one, ["u", "w"], "left").join(hop, ["u", "w"], "left").where("(d1 IS NULL OR s.d < d1) AND (d2 IS NULL OR s.d < d2)")
        cuts = cut(need.select(F.col("u").alias("node_a"), F.col("w").alias("node_b"), F.col("s.d").alias("weight"), F.col("s.v").cast("int").alias("mid")), "ch-shortcuts")
        arcs = arcs.unionByName(cuts)
        live = cut(rest.unionByName(cuts.select("node_a", "node_b", "weight")).groupBy("node_a", "node_b").agg(F.min("weight").alias("weight")), "ch-live")
        done = pick.select("node", F.lit(level).alias("level"))
        levels = done if levels is None else levels.unionByName(done)
        left = cut(left.join(pick, "node", "left_anti"), "ch-left")
        level += 1
    core = left.unionByName(kept).select("node", F.lit(level).alias("level"))
    levels = core if levels is None else levels.unionByName(core)
    best = arcs.groupBy("node_a", "node_b").agg(F.min(F.struct("weight", F.coalesce(F.col("mid"), F.lit(-1)).alias("m"))).alias("s"))
    return cut(levels, "ch-levels"), cut(best.select("node_a", "node_b", F.col("s.weight").alias("weight"), F.when(F.col("s.m") >= 0, F.col("s.m")).alias("mid")), "ch-all")


def up_and_down(levels: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs to the same or a higher level (the core is level), and arcs to a lower one with the level of their tail."""
    a, b = levels.select(F.col("node").alias("node_a"), F.col("level").alias("la")), levels.select(F.col("node").alias("node_b"), F.col("level").alias("lb"))
    both = arcs.join(a, "node_a").join(b, "node_b")
    return both.where("lb >= la").select("node_a", "node_b", "weight"), both.where("lb < la").select("node_a", "node_b", "weight", "la", "lb")


def query(levels: DataFrame, arcs: DataFrame, source: int, target: int, max_range: int = 2**30) -> DataFrame:
    """(node, dist): where the upward searches from both ends meet."""
    spark = arcs.sparkSession
    up, _ = up_and_down(levels, arcs)
    up_back, _ = up_and_down(levels, backward(arcs))
    seed = lambda n: spark.createDataFrame([(n, n, 0)], "src int, node int, dist int")
    return meet(fixpoint(up, seed(source), max_range), fixpoint(up_back, seed(target), max_range))


def sweep(levels: DataFrame, arcs: DataFrame, seeds: DataFrame, max_range: int, targets: DataFrame | None = None) -> DataFrame:
    """(src, node, dist) to all nodes, or with targets (node) to these and what they need.

    Upward searches, then one join a level from the top down; the range cuts both. Targets restrict the downward arcs
    to their closure, found once for all sources.
    """
    up, down = up_and_down(levels, arcs)
    down = cut(down, "sweep-down")
    if targets is not None:
        need = cut(targets.select("node").distinct(), "sweep-need")
        front = need
        while not front.isEmpty():
            front = cut(down.join(front, down["node_b"] == front["node"]).select(F.col("node_a").alias("node")).distinct().join(need, "node", "left_anti"), "sweep-front")
            need = cut(need.unionByName(front), "sweep-need")
        down = cut(down.join(need, down["node_b"] == need["node"], "left_semi"), "sweep-down")
    return downward(fixpoint(up, seeds, max_range), down, max_range)


def downward(best: DataFrame, down: DataFrame, max_range: int) -> DataFrame:
    """Labels (src, node, dist) carried down the arcs, a join a level; nodes that no label reached take no part."""
    for r in down.select("lb").distinct().orderBy(F.desc("lb")).collect():  # levels, not nodes
        step = best.join(down.where(F.col("lb") == r["lb"]), F.col("node") == F.col("node_a")).select("src", F.col("node_b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        best = cut(best.unionByName(step.where(F.col("dist") <= max_range)).groupBy("src", "node").agg(F.min("dist").alias("dist")), "sweep")
    return best


def unpack(arcs: DataFrame, route: DataFrame) -> DataFrame:
    """route (place array<int>, node_a, node_b) of arcs as edges in path order: shortcuts are replaced by their halves."""
    out, todo = None, route
    while True:
        joined = cut(todo.join(arcs, ["node_a", "node_b"]).select("place", "node_a", "node_b", "weight", "mid"), "unpack")
        flat = joined.where("mid IS NULL").select("place", "node_a", "node_b", "weight")
        out = flat if out is None else out.unionByName(flat)
        halves = joined.where("mid IS NOT NULL")
        if halves.isEmpty():
            return out.orderBy("place")
        half = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("node_a").alias("a"), F.col("mid").alias("b")), F.struct(F.lit(1).alias("i"), F.col("mid").alias("a"), F.col("node_b").alias("b"))))
        todo = halves.select("place", half.alias("h")).select(F.concat("place", F.array("h.i")).alias("place"), F.col("h.a").alias("node_a"), F.col("h.b").alias("node_b"))
