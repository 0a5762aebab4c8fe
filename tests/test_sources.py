"""Sources and sinks on small files, and ids beyond 32 bits from a network to a matrix."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import geo
from meridia.operators import kernel, search, snap
from meridia.plans import matrix as api
from meridia.sources import catalogue, geojson, gtfs, osm, tabular

BIG = 12_000_000_000


@pytest.fixture(scope="module")
def world(spark):
    """Two crossing ways, a one-way, a closed loop, a loop with a tail, and a path that is no road."""
    places = {1: (7.0, 50.0), 2: (7.01, 50.0), 3: (7.02, 50.0), 4: (7.01, 50.01), 5: (7.01, 49.99), 6: (7.03, 50.0), 7: (7.03, 50.01), 8: (7.02, 50.01), 9: (7.05, 50.0)}
    ways = [(1, [1, 2, 3], {"highway": "residential"}), (2, [4, 2, 5], {"highway": "residential"}), (3, [3, 6], {"highway": "residential", "oneway": "yes"}), (4, [6, 7, 8, 6], {"highway": "residential"}), (5, [6, 7, 8, 6, 9], {"highway": "residential"}), (6, [1, 9], {"highway": "proposed"})]
    rows = [("node", BIG + i, x, y, None, {}) for i, (x, y) in places.items()] + [("way", BIG + i, None, None, [BIG + r for r in refs], tags) for i, refs, tags in ways]
    return spark.createDataFrame(rows, "kind string, id long, lon double, lat double, refs array<long>, tags map<string,string>")


def test_network_of_crossings_loops_and_oneways(world):
    nodes, edges = osm.network(world)
    got = {(r.node_a - BIG, r.node_b - BIG, len(r.geom)) for r in edges.collect()}
    both = lambda a, b, n: {(a, b, n), (b, a, n)}
    junctions = {r.node_id - BIG for r in nodes.collect()}
    assert {1, 2, 3, 4, 5, 6, 9} <= junctions
    assert both(1, 2, 2) | both(2, 3, 2) | both(4, 2, 2) | both(2, 5, 2) | {(3, 6, 2)} <= got
    assert (6, 3, 2) not in got and not any(a == b for a, b, _ in got)


def test_a_way_goes_on_where_it_returns_to_its_start(spark):
    rows = [("node", i, 7 + i / 100, 50.0, None, {}) for i in range(1, 5)] + [("way", 1, None, None, [1, 2, 3, 1, 4], {"highway": "residential"})]
    _, edges = osm.network(spark.createDataFrame(rows, "kind string, id long, lon double, lat double, refs array<long>, tags map<string,string>"))
    assert {(r.node_a, r.node_b, len(r.geom)) for r in edges.collect()} == {(1, 4, 5), (4, 1, 5)}


def test_ids_beyond_32_bits_reach_the_matrix(spark, world):
    nodes, edges = osm.network(world)
    edges = edges.withColumn("weight", F.greatest(F.lit(1), F.col("length").cast("int")))
    points = spark.createDataFrame([(0, 7.0, 50.0), (1, 7.01, 50.01), (2, 3.0, 3.0)], "point_id int, lon double, lat double")
    assert {r.point_id: r.node_id for r in snap.snap(points, nodes).collect()} == {0: BIG + 1, 1: BIG + 4, 2: -1}
    seeds = search.seeds_of(spark.createDataFrame([(BIG + 1,)], "node_id long"))
    want = {(r.node, r.dist) for r in search.fixpoint(edges, seeds, 10_000).collect()}
    assert {(r.node, r.dist) for r in kernel.one_to_many(edges, seeds, 10_000).collect()} == want and len(want) > 5
    cells = {(r.source, r.target): r.distance for r in api.matrix(nodes, edges, points, points, 10_000).collect()}
    assert len(cells) == 9 and cells[0, 0] == 0 and cells[0, 1] > 0 and cells[0, 2] == cells[2, 0] == -1


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text)
    return f"file://{folder}"


def test_gtfs_folder_by_day(spark, tmp_path):
    path = write(
        tmp_path,
        stops="stop_id,stop_lon,stop_lat,parent_station,location_type\nS,7.0,50.0,,1\nP,7.0001,50.0,S,0\nE,0,0,S,2\nB,0,0,P,4\nA,7.1,50.0,,0\nO,7.2,50.0,X,0\nF,9.0,50.0,,0\n",
        calendar="service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nwk,1,1,0,0,0,0,0\n",
        trips="route_id,service_id,trip_id\nr,wk,t1\nr,wk,t2\nr,none,t3\n",
        stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"{t},{h}:00:00,{h}:01:00,P,1\n{t},{h}:10:00,{h}:11:00,A,2\n{t},{h}:20:00,{h}:21:00,F,3\n" for t, h in (("t1", "08"), ("t2", "25"), ("t3", "09"))),
    )
    area = geo.in_envelope(F.col("lon"), F.col("lat"), [[(6.0, 49.0), (8.0, 51.0)]])
    assert {r.stop_id: r.root for r in gtfs.stops(spark, path, area).collect()} == {"S": "S", "P": "S", "E": "S", "B": "S", "A": "A"}
    places, conns, schedule = gtfs.by_day(spark, path, area)
    assert {r.stop_id for r in places.collect()} == {"S", "A"}
    assert [(r.stop_a, r.stop_b) for r in conns.collect()] == [("S", "A")]
    assert sorted((r.day, r.departure, r.arrival) for r in schedule.collect()) == sorted((d, h * 3600 + 60, h * 3600 + 600) for d in ("monday", "tuesday") for h in (8, 25))


def test_lenient_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;age;height;gender\nx;1;1.5;true\n;;\ny;;a;\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("height", T.FloatType()), T.StructField("gender", T.BooleanType())])
    got = [tuple(r) for r in tabular.read_csv(spark, f"file://{tmp_path}/a.csv", schema, ";").collect()]
    assert ("x", 1, 1.5, True) in got and ("y", 0, 0.0, False) in got


def test_text_tables(spark, tmp_path):
    (tmp_path / "tiles").write_text("3\n1\n2\n")
    assert [(r.node_id, r.tile) for r in tabular.read_tiles(spark, f"file://{tmp_path}/tiles").collect()] == [(0, 3), (1, 1), (2, 2)]
    (tmp_path / "order").write_text("2\n0 1\n1 0\n")
    assert {(r.node_id, r.place) for r in tabular.read_ordering(spark, f"file://{tmp_path}/order").collect()} == {(0, 1), (1, 0)}
    (tmp_path / "points").write_text("1.5 2 3\n\n")
    assert [tuple(r) for r in tabular.read_points(spark, f"file://{tmp_path}/points").collect()] == [(1.5, 2.0, 3.0)]
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2)], "node_a int, node_b int")
    assert {r.node: r.line for r in tabular.metis(edges).collect()} == {0: "2", 1: "1 3", 2: "2"}


def test_features_in_and_out(spark, tmp_path):
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "value int, at array<double>")
    made = points.select(geojson.feature("Point", F.col("at"), value=F.col("value")).alias("f"))
    geojson.write_features(made, "f", f"file://{tmp_path}/lines")
    whole = json.loads(geojson.collection(made, "f").first().value)
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.json").write_text(json.dumps(whole))
    back = geojson.read_features(spark, f"file://{tmp_path}/whole")
    got = back.select(geojson.coordinates(F.col("coordinates"), "Point").alias("c"), "properties", "type").collect()
    assert sorted((r.type, tuple(r.c), json.loads(r.properties)["value"]) for r in got) == [("Point", (1.0, 2.0), 1), ("Point", (3.0, 4.0), 2)]
    with pytest.raises(ValueError):
        geojson.feature("Circle", F.col("at"))


def test_route_with_geometry(spark):
    rows = [(i, i, i + 1, 1) for i in range(10)] + [(20, 0, 5, 9), (21, 3, 2, 1)]
    edges = spark.createDataFrame([(*r, [(float(r[1]), 0.0), (float(r[2]), 0.0)]) for r in rows], "edge_id int, node_a int, node_b int, weight int, geom array<struct<lon:double,lat:double>>")
    steps = search.route(edges, 0, 9)
    assert [r.edge_id for r in steps.orderBy("seq").collect()] == list(range(9))
    assert search.route(edges, 9, 0).count() == 0
    lines = [json.loads(r.feature) for r in geojson.route_features(steps, edges).orderBy("seq").collect()]
    assert [x["geometry"]["coordinates"][0][0] for x in lines] == list(map(float, range(9))) and {x["properties"]["value"] for x in lines} == {0}
    bound = spark.createDataFrame([(n, max(9 - n, 0)) for n in range(11)], "node int, bound int")
    assert [r.edge_id for r in search.route(edges, 0, 9, bound).orderBy("seq").collect()] == list(range(9))


def test_profiles_and_their_descriptions(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    catalogue.store(spark.range(3), folder, "nodes")
    catalogue.store_meta(spark, folder, "car", {"type": "driving", "metric": "fastest"})
    catalogue.store_meta(spark, folder, "car", {"type": "driving", "metric": "shortest"})
    catalogue.store_meta(spark, folder, "foot", {"type": "walking"})
    assert catalogue.load_meta(spark, folder) == {"car": {"type": "driving", "metric": "shortest"}, "foot": {"type": "walking"}}
    assert catalogue.load_profile(spark, folder, "nodes")["nodes"].count() == 3
    assert catalogue.remove(spark, folder, "nodes")
