"""A profile from a network to answers of requests, and graphs written in other forms."""

import json

import pytest
from pyspark.sql import functions as F

from meridia.plans import profile
from meridia.sources import catalogue, geojson, tabular
from tests.test_catalogue import heap_search


@pytest.fixture(scope="module")
def world(spark):
    """A grid of 4 by 4 nodes with edges both ways, and a node pair that nothing reaches."""
    rows = []
    for x in range(4):
        for y in range(4):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < 4 and y + dy < 4:
                    for a, b in (((x, y), (x + dx, y + dy)), ((x + dx, y + dy), (x, y))):
                        rows.append((len(rows), a[0] * 4 + a[1], b[0] * 4 + b[1], 7, 1000.0 + 10 * len(rows), 50))
    rows.append((len(rows), 16, 17, 1, 5.0, 50))
    nodes = spark.createDataFrame([(i, 8.0 + i // 4 * 0.2, 50.0 + i % 4 * 0.2) for i in range(16)] + [(16, 1.0, 1.0), (17, 1.2, 1.0)], "node_id int, lon double, lat double")
    return nodes, spark.createDataFrame(rows, "edge_id int, node_a int, node_b int, road_type int, length float, maxspeed int"), rows


def test_profile_from_network_to_answer(spark, world, tmp_path):
    nodes, edges, rows = world
    folder = f"file://{tmp_path}/profiles"
    spec = catalogue.read_config("profiles:\n  roads:\n    type: driving\n    metric: distance\n")["roads"]
    profile.build(spark, folder, "roads", spec, nodes, edges)
    base = profile.view(spark, folder, "roads")
    assert base["nodes"].count() == 16 and base["edges"].count() == len(rows) - 1
    want = heap_search([(a, b, int(m)) for _, a, b, _, m, _ in rows], 0)
    at = lambda n: [8.0 + n // 4 * 0.2, 50.0 + n % 4 * 0.2]
    asked = profile.read_request(json.dumps({"sources": [at(0)], "destinations": [at(n) for n in range(16)] + [[0, 0]], "profile": "driving-car", "metric": "distance"}))
    assert {r.target: r.distance for r in profile.answer(spark, folder, asked).collect()} == {n: want[n] for n in range(16)} | {16: -1}
    square = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[8.1, 49.9], [8.3, 49.9], [8.3, 50.9], [8.1, 50.9]]]}}
    got = {r.target: r.distance for r in profile.answer(spark, folder, asked | {"avoid_area": square}).collect()}
    assert all((got[n] == -1) == (n >= 4) for n in range(17))
    assert profile.prepare(spark, folder, "roads", "tiled_hierarchy", "skeleton", "overlay", "hierarchy", most=6) == ["partition", "tiled_hierarchy", "skeleton", "overlay", "hierarchy"]
    assert profile.prepare(spark, folder, "roads", "skeleton") == ["partition", "tiled_hierarchy", "skeleton", "overlay", "hierarchy"]
    for kind in ("hierarchy", "tiled", "skeleton", "tiled_hierarchy"):
        assert all(t.count() >= 0 for t in profile.view(spark, folder, "roads", kind).values())
    assert profile.view(spark, folder, "roads", "tiled")["tiles"].groupBy("tile").count().agg(F.max("count")).first()[0] <= 6


@pytest.mark.parametrize("change", [{"sources": None}, {"destinations": [[1]]}, {"profile": 3}, {"max_range": -1}, {"metric": "beauty"}, {"avoid_roads": ["moonway"]}])
def test_requests_that_do_not_fit(change):
    with pytest.raises(ValueError):
        profile.read_request(json.dumps({"sources": [[1, 2]], "destinations": [], "profile": "driving-car"} | change))


def test_weights(spark, world):
    _, edges, _ = world
    row = profile.weighed(edges, "car").where("edge_id = 0").first()
    assert row.weight == 72  # 1000 m at 50 km/h
    assert profile.weighed(edges, metric="shortest").first().weight == 1000
    assert {r.weight for r in profile.weighed(edges, weight=F.lit(1)).collect()} == {1}


def test_graphs_in_other_forms(spark, tmp_path):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "node_id int, lon double, lat double")
    edges = spark.createDataFrame([(0, 0, 1, 5), (1, 1, 0, 5), (2, 1, 2, 4)], "edge_id int, node_a int, node_b int, weight int")
    tabular.write_metis(nodes, edges, f"file://{tmp_path}/metis")
    text = "".join(p.read_text() for p in sorted((tmp_path / "metis").glob("part-*")))
    assert text.split("\n") == ["4 2", "2", "1 3", "2", "", ""]
    order = spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "node_id int, place int")
    tabular.write_ordering(order, f"file://{tmp_path}/order")
    assert sorted(map(tuple, tabular.read_ordering(spark, f"file://{tmp_path}/order").collect())) == [(0, 3), (1, 1), (2, 2)]
    shapes = [json.loads(r.feature) for r in geojson.graph_features(nodes, edges).collect()]
    assert sorted(s["geometry"]["type"] for s in shapes) == ["LineString"] * 3 + ["Point"] * 4
    assert [s["geometry"]["coordinates"] for s in shapes if s["properties"].get("edge_id") == 2] == [[[1.0, 0.0], [2.0, 0.0]]]
    spots = spark.createDataFrame([(8.0, 50.0, 2.5)], "lon double, lat double, weight double")
    assert json.loads(geojson.point_features(spots).first().feature)["properties"] == {"weight": 2.5}
