"""OpenStreetMap extracts: a PBF data source that reads one partition a blob, and the network made of ways."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geo import line_length
from ..functions.roads import HIGHWAYS, is_oneway, road_type, travel_speed

SCHEMA = "kind string, id bigint, lon double, lat double, refs array<bigint>, tags map<string,string>"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    i, n = 0, len(data)
    while i < n:
        key, i = _varint(data, i)
        if key & 7 == 0:
            value, i = _varint(data, i)
        elif key & 7 == 2:
            size, i = _varint(data, i)
            value, i = data[i : i + size], i + size
        elif key & 7 == 5:
            value, i = data[i : i + 4], i + 4
        else:
            value, i = data[i : i + 8], i + 8
        yield key >> 3, value


def _varint(data: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[i]
        i += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, i
        shift += 7


def _packed(data: bytes) -> list[int]:
    out, i = [], 0
    while i < len(data):
        v, i = _varint(data, i)
        out.append(v)
    return out


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += _zigzag(v)
        out.append(total)
    return out


def decode_block(data: bytes) -> Iterator[tuple]:
    """Rows of one primitive block."""
    strings, groups, grain, off_lat, off_lon = [], [], 100, 0, 0
    for k, v in _fields(data):
        if k == 1:
            strings = [x.decode("utf-8", "replace") for n, x in _fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            off_lat = v
        elif k == 20:
            off_lon = v
    degrees = lambda off, x: 1e-9 * (off + grain * x)
    for g in groups:
        for k, v in _fields(g):
            if k == 1:
                f = dict(_fields(v))
                tags = dict(zip((strings[x] for x in _packed(f.get(2, b""))), (strings[x] for x in _packed(f.get(3, b""))), strict=True))
                yield "node", _zigzag(f[1]), degrees(off_lon, _zigzag(f[9])), degrees(off_lat, _zigzag(f[8])), None, tags
            elif k == 2:
                f = dict(_fields(v))
                ids, lats, lons = (_running(_packed(f[x])) for x in (1, 8, 9))
                kv, at = _packed(f.get(10, b"")), 0
                for i, la, lo in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, degrees(off_lon, lo), degrees(off_lat, la), None, tags
            elif k == 3:
                f = dict(_fields(v))
                tags = dict(zip((strings[x] for x in _packed(f.get(2, b""))), (strings[x] for x in _packed(f.get(3, b""))), strict=True))
                yield "way", f[1], None, None, _running(_packed(f.get(8, b""))), tags


class Blob(InputPartition):
    def __init__(self, path: str, at: int, size: int):
        self.path, self.at, self.size = path, at, size


class PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return open(self.path, "rb")
        store, path = fs.FileSystem.from_uri(self.path)
        return store.open_input_file(path)

    def partitions(self) -> list[Blob]:
        """Reads the headers only."""
        out, at = [], 0
        with self._open() as f:
            while True:
                f.seek(at)
                if len(head := f.read(4)) < 4:
                    return out
                n = struct.unpack(">I", head)[0]
                h = dict(_fields(f.read(n)))
                if h[1] == b"OSMData":
                    out.append(Blob(self.path, at + 4 + n, h[3]))
                at += 4 + n + h[3]

    def read(self, partition: Blob) -> Iterator[tuple]:
        with self._open() as f:
            f.seek(partition.at)
            blob = dict(_fields(f.read(partition.size)))
        yield from decode_block(blob[1] if 1 in blob else zlib.decompress(blob[3]))


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"])


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("path", path).load()


def network(osm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the road network of OSM rows.

    Ways with a highway of the network count; a node that two ways or ends share is a junction. Ways are cut at junctions, but not where
    they come back to the junction that a segment began at; a way that isn't one-way also yields the reverse edge. Nodes missing from the file drop their segments' points.
    """
    ways = osm.where((F.col("kind") == "way") & F.col("tags")["highway"].isin(HIGHWAYS)).select("id", "refs", "tags")
    refs = ways.select("id", "tags", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "ref"))
    uses = refs.withColumn("u", F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1), 2).otherwise(1)).groupBy("ref").agg(F.sum("u").alias("uses"))
    spots = osm.where(F.col("kind") == "node").select(F.col("id").alias("ref"), "lon", "lat").join(uses, "ref")
    nodes = spots.where("uses > 1").select(F.col("ref").alias("node_id"), "lon", "lat")
    at = refs.join(spots, "ref").withColumn("cut", (F.col("uses") > 1).cast("int"))
    points = F.array_sort(F.collect_list(F.struct("pos", "ref", "lon", "lat", "cut")))
    whole = at.groupBy("id").agg(F.first("tags").alias("tags"), points.alias("g"))
    # a way is cut at its first junction, and then wherever a junction differs from the one that the segment began at; a way has 2000 nodes at most
    begun = F.struct(F.lit(None).cast("long").alias("start"), F.array().cast("array<int>").alias("cuts"))
    numbered = F.transform("g", lambda x, i: F.struct(x["ref"].alias("ref"), x["cut"].alias("cut"), i.alias("i")))
    step = lambda s, x: F.when((x["cut"] == 1) & (s["start"].isNull() | (s["start"] != x["ref"])), F.struct(x["ref"].alias("start"), F.array_append(s["cuts"], x["i"]).alias("cuts"))).otherwise(s)
    cuts = whole.withColumn("cuts", F.aggregate(numbered, begun, step, lambda s: s["cuts"])).where("size(cuts) > 1")
    line = cuts.select("id", "tags", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)).alias("s"), "g", "cuts")
    line = line.select("id", "tags", "s", F.expr("slice(g, cuts[s] + 1, cuts[s + 1] - cuts[s] + 1)").alias("g"))
    t = F.col("tags")
    base = line.select(
        "id",
        "s",
        F.col("g")[0]["ref"].alias("a"),
        F.element_at("g", -1)["ref"].alias("b"),
        road_type(t["highway"]).alias("road_type"),
        travel_speed(t["highway"], t["maxspeed"], t["tracktype"], t["surface"]).alias("maxspeed"),
        is_oneway(t["highway"], t["oneway"]).alias("oneway"),
        F.transform("g", lambda x: F.struct(x["lon"].cast("float").alias("lon"), x["lat"].cast("float").alias("lat"))).alias("geom"),
    ).withColumn("length", line_length("geom").cast("float"))
    ends = F.when(F.col("oneway"), F.array(F.struct(F.col("a"), F.col("b")))).otherwise(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = base.select("id", "s", "road_type", "maxspeed", "oneway", "length", "geom", F.posexplode(ends).alias("dir", "e"))
    return nodes, both.select(F.struct("id", "s", "dir").alias("edge_key"), F.col("e.a").alias("node_a"), F.col("e.b").alias("node_b"), "road_type", "maxspeed", "oneway", "length", "geom")
