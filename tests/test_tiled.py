"""Searches on tiles, hierarchies that keep border nodes, and isochrone polygons, against a plain search."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meridia.operators import hierarchy, raster, search, tiled, tiles
from meridia.plans import matrix as api
from tests.test_catalogue import heap_search


@pytest.fixture(scope="module")
def town(spark):
    """48 nodes of 6 tiles, edges mostly within a tile; node 47 has no edge."""
    rnd = random.Random(7)
    edges = []
    for a in range(47):
        for _ in range(3):
            b = rnd.randrange(47) if rnd.random() < 0.2 else a // 8 * 8 + rnd.randrange(8)
            if b != a and b < 47:
                edges.append((len(edges), a, b, rnd.randint(1, 30)))
    return (
        edges,
        spark.createDataFrame([(i, float(i % 8), float(i // 8)) for i in range(48)], "node_id int, lon double, lat double"),
        spark.createDataFrame(edges, "edge_id int, node_a int, node_b int, weight int"),
        spark.createDataFrame([(i, i // 8) for i in range(48)], "node_id int, tile int"),
    )


def walked(steps, edges, source, target):
    """The cost of a path, after checking that its edges follow one another."""
    by_id, at, total = {e[0]: e for e in edges}, source, 0
    for r in sorted(steps.collect(), key=lambda r: r.seq):
        _, a, b, w = by_id[r.edge_id]
        assert a == at
        at, total = b, total + w
    assert at == target
    return total


def test_tiled_paths_are_shortest(town):
    edges, _, e, t = town
    want = heap_search([x[1:] for x in edges], 0)
    target = max((n for n in want), key=lambda n: want[n])
    marked = tiled.skeleton(e, t)
    assert walked(tiled.skeleton_route(marked, t, 0, target), edges, 0, target) == want[target]
    assert walked(tiled.superstep_route(e, t, 0, target), edges, 0, target) == want[target]
    assert tiled.superstep_route(e, t, 0, 47).count() == 0 and tiled.skeleton_route(marked, t, 0, 47).count() == 0


def test_border_hierarchy_keeps_borders_and_tiles(spark, town):
    edges, n, e, t = town
    levels, arcs = tiled.border_hierarchy(n, e, t)
    level = {r.node: r.level for r in levels.collect()}
    border = {r.node for r in tiles.border_nodes(e, t).collect()}
    assert set(level) == set(range(48)) and all(level[b] == max(level.values()) for b in border)
    index = tiled.tile_index(levels, arcs, t)
    assert all(r.node_a // 8 == r.node_b // 8 == r.tile for r in index.collect())
    seeds = spark.createDataFrame([(s, s, 0) for s in (0, 20)], "src int, node int, dist int")
    got = {(r.src, r.node): r.dist for r in tiled.tile_sweep(levels, arcs, index, t, seeds, 80).collect()}
    assert got == {(s, m): d for s in (0, 20) for m, d in heap_search([x[1:] for x in edges], s).items() if d <= 80}


def test_a_given_order_is_kept_between_neighbours(spark, town):
    edges, n, e, _ = town
    order = spark.createDataFrame([(i, i) for i in range(48)], "node int, place int")
    level = {r.node: r.level for r in hierarchy.contract(n, e, rounds=100, degree=1e9, order=order)[0].collect()}
    assert all((level[a] < level[b]) == (a < b) for _, a, b, _ in edges)


def test_bounds_do_not_change_a_search_from_both_ends(spark, town):
    edges, _, e, _ = town
    ahead = heap_search([(b, a, w) for _, a, b, w in edges], 9)
    behind = heap_search([x[1:] for x in edges], 0)
    bounds = [spark.createDataFrame(list(d.items()), "node int, bound int") for d in (ahead, behind)]
    got = search.both_ways(e, 0, 9, *bounds).collect()
    assert [r.dist for r in got] == ([behind[9]] if 9 in behind else [])


def test_rings_with_holes(spark):
    cells = spark.createDataFrame([(0, x, y, 300 if (x, y) == (2, 2) else 100) for x in range(5) for y in range(5)], "src int, x int, y int, value int")
    rings = raster.rings(raster.marching_keys(cells, 200)).withColumn("value", F.lit(200))
    moved = raster.interpolated(rings, cells)
    shape = raster.polygons(moved, "src", "value").collect()
    assert len(shape) == 1 and len(shape[0].rings) == 2
    hole = {tuple(p) for p in shape[0].rings[1]}
    assert hole == {(1.5, 2.0), (2.5, 2.0), (2.0, 1.5), (2.0, 2.5)}  # 200 lies midway between 100 and 300
    near = raster.interpolated(rings.withColumn("value", F.lit(150)), cells).where("area < 0").first().ring
    assert {tuple(p) for p in near} == {(1.25, 2.0), (2.75, 2.0), (2.0, 1.25), (2.0, 2.75)}


def test_isochrone_features_are_closed_polygons(spark, town):
    _, n, e, _ = town
    rows = api.isochrone_features(n, e, spark.createDataFrame([(0,)], "node_id int"), [20, 60], 50000.0).collect()
    assert {r.value for r in rows} <= {20, 60} and rows
    for r in rows:
        f = json.loads(r.feature)
        assert f["properties"]["value"] == r.value and all(ring[0] == ring[-1] and len(ring) > 3 for ring in f["geometry"]["coordinates"])


@pytest.mark.parametrize("spots", [[(float(i % 7), float(i // 7)) for i in range(40)], [(1.0, 2.0)] * 40, [(0.0, 0.0)] * 30 + [(1.0, 0.0)] * 10, []])
def test_halving_by_place(spark, spots):
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "node_id int, lon double, lat double")
    got = tiles.bisected(nodes, 6).collect()
    sizes = Counter(r.tile for r in got)
    assert sorted(r.node_id for r in got) == list(range(len(spots))) and all(n <= 6 for n in sizes.values())
    assert not any(a != b and bin(b).startswith(bin(a)) for a in sizes for b in sizes)


def test_cells_of_flow_after_halving(spark, town):
    _, n, e, _ = town
    sizes = Counter(r.tile for r in tiles.inertial_flow(n, e, most=8, task=20).collect())
    assert sum(sizes.values()) == 48 and max(sizes.values()) <= 8
