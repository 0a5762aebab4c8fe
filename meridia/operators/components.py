"""Reachability and strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import backward
from .store import cut


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(src, node): everything that each source reaches; starts (src, node)."""
    seen = cut(starts.distinct(), "reach")
    front = seen
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["node_a"]).select("src", F.col("node_b").alias("node")).distinct()
        front = cut(step.join(seen, ["src", "node"], "left_anti"), "reach-front")
        seen = cut(seen.unionByName(front), "reach")
    return seen


def scc_of(edges: DataFrame, node: int) -> DataFrame:
    """Nodes that a node reaches and that reach it."""
    start = edges.sparkSession.createDataFrame([(node, node)], "src int, node int")
    return reach(edges, start).select("node").intersect(reach(backward(edges), start).select("node"))


def _spread_min(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along the edges."""
    front = labels
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["node_a"]).groupBy(F.col("node_b").alias("node")).agg(F.min("label").alias("label"))
        front = cut(step.join(labels.withColumnRenamed("label", "_old"), "node").where("label < _old").select("node", "label"), "scc-front")
        labels = cut(labels.unionByName(front).groupBy("node").agg(F.min("label").alias("label")), "scc-label")
    return labels


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node of the strongly connected component.

    Colouring: the least label that reaches a node forwards is its colour; the nodes of a colour that its root reaches
    backwards within the colour are one component. Nodes without in- or out-edges are trimmed first. All roots of a round are
    handled at once.
    """
    left = cut(nodes.select(F.col("node_id").alias("node")), "scc-left")
    edges = cut(edges.select("node_a", "node_b").where("node_a <> node_b").distinct(), "scc-edges")
    found = None
    while not left.isEmpty():
        ends = edges.select(F.col("node_a").alias("node")).intersect(edges.select(F.col("node_b").alias("node")))
        alone = left.join(ends, "node", "left_anti").select("node", F.col("node").alias("component"))
        body = cut(left.join(ends, "node", "left_semi"), "scc-body")
        part = alone
        if not body.isEmpty():
            inner = cut(_inside(edges, body), "scc-inner")
            colour = _spread_min(inner, body.select("node", F.col("node").alias("label")))
            a, b = (colour.select(F.col("node").alias(f"node_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
            same = inner.join(a, "node_a").join(b, "node_b").where("label_a = label_b").select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"))
            roots = colour.where("node = label").select(F.col("label").alias("src"), "node")
            part = alone.unionByName(reach(cut(same, "scc-same"), roots).select("node", F.col("src").alias("component")))
        part = cut(part, "scc-part")
        found = part if found is None else found.unionByName(part)
        left = cut(left.join(part, "node", "left_anti"), "scc-left")
        edges = cut(_inside(edges, left), "scc-edges")
    return found if found is not None else left.select("node", F.col("node").alias("component"))


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("node").alias("node_a")), nodes.select(F.col("node").alias("node_b"))
    return edges.join(a, "node_a", "left_semi").join(b, "node_b", "left_semi").select("node_a", "node_b")


def largest(components: DataFrame) -> DataFrame:
    """Nodes of the largest component; ties go to the smaller component."""
    top = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return components.join(F.broadcast(top), "component", "left_semi").select("node")  # one row


def keep_nodes(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without other nodes and the edges at them."""
    k = kept.select(F.col("node").alias("node_id"))
    a, b = kept.select(F.col("node").alias("node_a")), kept.select(F.col("node").alias("node_b"))
    return nodes.join(k, "node_id", "left_semi"), edges.join(a, "node_a", "left_semi").join(b, "node_b", "left_semi")
