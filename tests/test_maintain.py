"""Maintenance of graph tables on a small graph."""

import pytest
from pyspark.sql import functions as F

from meridia.operators import hierarchy, maintain, search


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(5)], "node_id int, lon double")
    edges = spark.createDataFrame([(0, 0, 1, 4), (1, 1, 2, 3), (2, 2, 3, 1), (3, 0, 3, 9), (4, 3, 4, 2)], "edge_id int, node_a int, node_b int, weight int")
    return nodes, edges


def test_renumbering(spark, graph):
    nodes, edges = graph
    turn = spark.createDataFrame([(i, 4 - i) for i in range(5)], "old int, new int")
    n, e = maintain.renumber(nodes, edges, turn)
    assert {r.node_id: r.lon for r in n.collect()} == {4 - i: float(i) for i in range(5)}
    assert {(r.edge_id, r.node_a, r.node_b) for r in e.collect()} == {(r.edge_id, 4 - r.node_a, 4 - r.node_b) for r in edges.collect()}
    assert all(r.old == r.new for r in maintain.compose(turn, turn).collect())
    assert {r.node_id for r in maintain.attributes(nodes, turn, "node_id").collect()} == set(range(5))
    tiles = spark.createDataFrame([(0, 2), (1, 1), (2, 2), (3, 1), (4, 0)], "node_id int, tile int")
    assert {r.old: r.new for r in maintain.order_by_tile(tiles).collect()} == {4: 0, 1: 1, 3: 2, 0: 3, 2: 4}
    assert maintain.tile_count(tiles) == 3 and maintain.tile_count(tiles.limit(0)) == 0
    short = spark.createDataFrame([(0, 0, 1, True), (0, 1, 1, False)], "shortcut_id int, place int, child int, is_edge boolean")
    assert [r.child for r in maintain.renumber_shortcuts(short, turn).orderBy("place").collect()] == [3, 1]


def test_merged_cells_and_ends(spark, graph):
    a, b = (spark.createDataFrame(r, "x int, y int, value int") for r in ([(0, 0, 5), (1, 0, 2)], [(0, 0, 3)]))
    assert {(r.x, r.y): r.value for r in maintain.merge_cells(a, b).collect()} == {(0, 0): 3, (1, 0): 2}
    got = graph[1].select(maintain.other_end(F.col("node_a"), F.col("node_b"), F.lit(0)).alias("o")).collect()
    assert [r.o for r in got] == [1, None, None, 3, None]


def test_betweenness_of_sampled_paths(spark, graph):
    _, edges = graph
    found = search.fixpoint(edges, spark.createDataFrame([(0, 0, 0)], "src int, node int, dist int"), 100)
    samples = spark.createDataFrame([(0, 4), (0, 2)], "src int, node int")
    got = {r.node: r.n for r in maintain.betweenness(search.tree(edges, found), samples, 6).collect()}
    assert got == {4: 1, 3: 1, 2: 2, 1: 2, 0: 2}


def test_checks(spark, graph):
    nodes, edges = graph
    assert maintain.check_graph(nodes, edges).count() == 0
    broken = edges.unionByName(spark.createDataFrame([(4, 1, 77, 0)], edges.schema))
    assert {(r.problem, r.n) for r in maintain.check_graph(nodes, broken).collect()} == {("loose_end", 1), ("repeated_edge", 1), ("bad_weight", 1)}
    levels, arcs = hierarchy.contract(nodes, edges)
    assert maintain.check_hierarchy(levels, arcs).count() == 0
    assert {r.problem for r in maintain.check_hierarchy(levels.where("node <> 0"), arcs).collect()} == {"no_level"}
    tiles = spark.createDataFrame([(i, i % 2) for i in range(4)], "node_id int, tile int")
    tagged = spark.createDataFrame([(0, 1, 10), (1, 1, 10)], "tile_a int, tile_b int, kind int")
    assert {(r.problem, r.n) for r in maintain.check_tiles(nodes, tiles, tagged).collect()} == {("no_tile", 1), ("wrong_kind", 1)}


def test_unpacked_shortcuts_are_edges(spark, graph):
    nodes, edges = graph
    _, arcs = hierarchy.contract(nodes, edges)
    one = arcs.where("mid IS NOT NULL").limit(1).select(F.array(F.lit(0)).alias("place"), "node_a", "node_b")
    if one.count():
        known = {(r.node_a, r.node_b): r.weight for r in edges.collect()}
        assert all((r.node_a, r.node_b) in known for r in hierarchy.unpack(arcs, one).collect())
