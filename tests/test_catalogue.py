"""Every registered network query against its SQL in DuckDB, on the smallest tables."""

import heapq
import math
import random
import re
from pathlib import Path

import duckdb
import pytest

from meridia.operators import snap
from meridia.plans import catalogue
from meridia.plans import fixtures as fx
from meridia.plans import matrix as api

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that sorts and compares alike from both engines."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    want = duck.execute(catalogue.ORACLE_SQL[name])
    assert table(got.columns, got.collect()) == table([c[0] for c in want.description], want.fetchall())


def heap_search(edges, start):
    """Distances from a node over (node_a, node_b, weight) rows, without Spark or SQL."""
    out, best, heap = {}, {}, [(0, start)]
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m, w in out.get(n, ()):
                heapq.heappush(heap, (d + w, m))
    return best


def test_hierarchy_and_overlay_search_the_whole_edge_table(spark):
    d = str(DATA)
    want = heap_search([(r.node_a, r.node_b, r.weight) for r in fx.edges(spark, d).collect()], 0)
    near = {n: x for n, x in want.items() if x <= catalogue.RANGE}
    for name in ("phast_all", "overlay_search"):
        assert {r.node: r.dist for r in catalogue.QUERIES[name](spark, d).collect()} == near
    assert [r.dist for r in catalogue.QUERIES["ch_query"](spark, d).collect()] == [want[9]]


def test_matrix_and_transit_ask_for_every_point_connection_and_departure(spark):
    d, run = str(DATA), lambda name: catalogue.QUERIES[name](spark, str(DATA)).collect()
    points, suppliers = ({r.point_id for r in f(spark, d).collect()} for f in (fx.points, fx.suppliers))
    cells = run("matrix")
    assert len(cells) == len(points) * len(suppliers) and {(r.source, r.target) for r in cells} == {(s, p) for s in suppliers for p in points}
    assert any(r.distance > 0 for r in cells)
    rows = fx.timetable(spark, d).collect()
    last = {}
    for r in rows:
        last[r.route_id, r.stop_a, r.stop_b] = max(r.departure, last.get((r.route_id, r.stop_a, r.stop_b), 0))
    assert len(run("next_departure")) == sum(t >= asked for t in last.values() for asked in (30000, 43200))
    labels = {(r.src, r.stop, r.time, r.departure) for r in run("pareto_labels")}
    for r in rows:
        assert any(t <= r.arrival and x >= r.departure for s, p, t, x in labels if (s, p) == (r.stop_a, r.stop_b))


def test_matrix_fills_cells_without_a_shuffle_of_them(spark):
    plan = catalogue.QUERIES["matrix"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "array_except" in plan and not re.search(r"hashpartitioning\(source#\d+L?, target#", plan)


@pytest.mark.parametrize("targets", [1, 7, 1000])
def test_matrix_has_each_cell_once_whatever_the_blocks(spark, monkeypatch, targets):
    monkeypatch.setattr(api, "TARGETS", targets)
    nodes = spark.createDataFrame([(i, 7 + i / 100, 50.0) for i in range(20)], "node_id int, lon double, lat double")
    edges = spark.createDataFrame([(i, i + 1, 10) for i in range(19)], "node_a int, node_b int, weight int")
    ask = spark.createDataFrame([(100 + i, 7 + i / 100, 50.0) for i in range(0, 20, 3)] + [(200, 0.0, 0.0), (201, 7.0, 50.0)], "point_id int, lon double, lat double")
    got = [tuple(r) for r in api.matrix(nodes, edges, ask, ask, 60).collect()]
    at = {100 + i: i for i in range(0, 20, 3)} | {201: 0, 200: None}
    far = lambda p, q: -1 if p is None or q is None or not 0 <= q - p <= 6 else 10 * (q - p)
    assert sorted(got) == sorted((s, t, far(at[s], at[t])) for s in at for t in at)


@pytest.mark.parametrize(("targets", "sources", "cells"), [(3, 2, 5), (256, 1, 4)])
def test_matrix_has_each_cell_once_whatever_the_tiles_and_tasks(spark, monkeypatch, targets, sources, cells):
    for name, value in (("TARGETS", targets), ("SOURCES", sources), ("CELLS", cells)):
        monkeypatch.setattr(api, name, value)
    nodes = spark.createDataFrame([(i, 7 + i / 100, 50.0) for i in range(9)], "node_id int, lon double, lat double")
    edges = spark.createDataFrame([(i, i + 1, 10) for i in range(8)], "node_a int, node_b int, weight int")
    ask = spark.createDataFrame([(10 + i, 7 + i / 100, 50.0) for i in range(9)] + [(90, 0.0, 0.0)], "point_id int, lon double, lat double")
    want = [(s, t, 10 * (t - s) if t < 90 and 0 <= t - s <= 4 else 0 if s == t < 90 else -1) for s in (*range(10, 19), 90) for t in (*range(10, 19), 90)]
    got = api.matrix(nodes, edges, ask, ask, 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and not re.search(r"hashpartitioning\((?:task|block)#\d+L?, [a-z]", plan)
    assert sorted(map(tuple, got.collect())) == want
    assert api.matrix(nodes, edges, *((ask.limit(0), ask) if sources == 1 else (ask, ask.limit(0))), 40).count() == 0


def test_matrix_takes_little_disk(spark, tmp_path):
    nodes = spark.createDataFrame([(i, 7 + i / 100, 50.0) for i in range(50)], "node_id int, lon double, lat double")
    edges = spark.createDataFrame([(i, i + 1, 10) for i in range(49)], "node_a int, node_b int, weight int")
    ask = lambda n: spark.range(n).selectExpr("CAST(id * 7919 % 1000003 AS INT) AS point_id", "7 + id % 500 / 1000D AS lon", "50D AS lat")
    api.matrix(nodes, edges, ask(50), ask(40000), 30).write.parquet(out := f"{tmp_path}/cells")
    assert spark.read.parquet(out).count() == 2_000_000
    assert sum(p.stat().st_size for p in Path(out).glob("*.parquet")) < 0.75 * 2_000_000


@pytest.mark.parametrize(
    "edges",
    [
        [(0, 1, 10), (1, 2, 499), (2, 9, 10)],
        [(0, 1, 1), (1, 2, 499), (2, 9, 1), (0, 3, 280), (3, 9, 280)],
        [(0, 1, 5), (9, 1, 5)],
    ],
)
def test_meet_in_middle_finds_paths_over_heavy_edges(spark, monkeypatch, edges):
    monkeypatch.setattr(fx, "edges", lambda spark, d: spark.createDataFrame(edges, "node_a int, node_b int, weight int"))
    want = heap_search(edges, 0).get(9)
    assert [r.dist for r in catalogue.QUERIES["meet_in_middle"](spark, "").collect()] == ([] if want is None else [want])


@pytest.mark.parametrize(("weights", "want"), [((300, 300), [600]), ((301, 300), []), ((700, 1), [])])
def test_meet_in_middle_ends_at_the_range_of_its_sql(spark, tmp_path, weights, want):
    rows = [(k, a, w * 1000.0) for k, (a, w) in enumerate(zip((0, 1, 9), (*weights, 0), strict=True))]
    spark.createDataFrame([(k, a, p, "2024-01-01") for k, a, p in rows], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for table in ("customer", "lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    assert [r[0] for r in con.execute(catalogue.ORACLE_SQL["meet_in_middle"]).fetchall()] == want
    assert [r.dist for r in catalogue.QUERIES["meet_in_middle"](spark, str(tmp_path)).collect()] == want


def test_snap_finds_the_nearest_node_in_crowds_at_edges_and_in_the_open(spark):
    rng = random.Random(5)
    crowd = [(i, 7 + rng.random() * 0.002, 50 + rng.random() * 0.002) for i in range(1500)]
    few = [(2000 + i, 7 + rng.random(), 50 + rng.random()) for i in range(200)]
    nodes = crowd + few + [(3000 + i, 7.5, 50.5) for i in range(300)] + [(5000, -8.0, -3.0)]  # 300 of one place
    points = [(i, x + rng.gauss(0, s), y + rng.gauss(0, s)) for i, (_, x, y) in enumerate(rng.sample(nodes, 300)) for s in [rng.choice((0.0, 0.0005, 0.02, 0.2))]]
    points += [(400, 7.5, 50.5), (401, -8.05, -3.0), (402, -8.0, -2.95), (403, -8.051, -3.0), (404, 7.5, 50.45), (405, 7.06, 50.001)]
    got = {r.point_id: r.node_id for r in snap.snap(spark.createDataFrame(points, "point_id int, lon double, lat double"), spark.createDataFrame(nodes, "node_id int, lon double, lat double")).collect()}
    want = {}
    for p, x, y in points:
        d, n = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), n) for n, a, b in nodes)
        want[p] = n if d <= 0.05 else -1
    assert got == want and -1 in want.values() and got[400] == 3000


def test_snap_meets_few_candidates_of_crowded_cells(spark):
    rng = random.Random(6)
    places = lambda name: spark.createDataFrame([(i, 7 + rng.random() * 0.2, 50 + rng.random() * 0.2) for i in range(3000)], f"{name} int, lon double, lat double")
    found = snap._finest(places("node_id").toDF("node_id", "_x", "_y"), snap.RADIUS)
    assert 2 * snap.RADIUS / 4**found < 0.01  # cells of a few nodes, where those of the radius held 190
    assert snap.snap(places("point_id"), places("node_id")).where("node_id >= 0").count() == 3000
