"""Rasters and isochrones from search results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell, cell_square, from_mercator, mercator_x, mercator_y


def cells(found: DataFrame, nodes: DataFrame, size: float) -> DataFrame:
    """(src, x, y, value): least distance per web-mercator cell."""
    placed = found.join(nodes.select(F.col("node_id").alias("node"), "lon", "lat"), "node")
    return placed.groupBy("src", cell(mercator_x(F.col("lon")), size).alias("x"), cell(mercator_y(F.col("lat")), size).alias("y")).agg(F.min("dist").alias("value"))


def squares(raster: DataFrame, size: float) -> DataFrame:
    """The raster with a closed square for each cell."""
    return raster.withColumn("ring", cell_square(F.col("x"), F.col("y"), size))


def edge_cells(found: DataFrame, edges: DataFrame, nodes: DataFrame, size: float, step: float = 50.0) -> DataFrame:
    """(src, x, y, value): edges sampled every ``step`` projected metres, costs interpolated, least per cell."""
    at = lambda s: nodes.select(F.col("node_id").alias(f"node_{s}"), mercator_x(F.col("lon")).alias(f"x_{s}"), mercator_y(F.col("lat")).alias(f"y_{s}"))
    on = found.join(edges, found["node"] == edges["node_a"]).join(at("a"), "node_a").join(at("b"), "node_b")
    length = F.hypot(F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a"))
    sampled = on.withColumn("_l", length).withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(F.col("_l") / step).cast("int"))))
    part = F.when(F.col("_l") > 0, F.col("_i") * step / F.col("_l")).otherwise(0.0)
    return sampled.select("src", cell(F.col("x_a") + (F.col("x_b") - F.col("x_a")) * part, size).alias("x"), cell(F.col("y_a") + (F.col("y_b") - F.col("y_a")) * part, size).alias("y"), (F.col("dist") + F.col("weight") * part).cast("int").alias("v")).groupBy("src", "x", "y").agg(F.min("v").alias("value"))


def marching_keys(raster: DataFrame, most: int) -> DataFrame:
    """(src, x, y, key): four corner bits 1, 2, 4, 8 of each square whose corners are cells within ``most``; 0 and 15 are left out."""
    corner = F.explode(F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8)))))
    inside = raster.where(F.col("value") <= most).select("src", corner.alias("c"))
    return inside.groupBy("src", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.bit").cast("int").alias("key")).where("key < 15")


# For a key the sides (0 south, 1 east, 2 north, 3 west) that a ring runs between, inside on its left.
SIDES = {1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 5: [(0, 3), (2, 1)], 6: [(2, 0)], 7: [(2, 3)], 8: [(3, 2)], 9: [(0, 2)], 10: [(1, 0), (3, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}


def rings(keys: DataFrame) -> DataFrame:
    """(src, ring, area): closed rings of half-cell points, a task per source; area is negative for holes."""
    return keys.groupBy("src").applyInPandas(_trace, "src int, ring array<array<double>>, area double")


def _trace(p: pd.DataFrame) -> pd.DataFrame:
    mid = {0: (0.5, 0.0), 1: (1.0, 0.5), 2: (0.5, 1.0), 3: (0.0, 0.5)}
    following: dict[tuple, tuple] = {}
    for x, y, k in zip(p["x"], p["y"], p["key"], strict=True):
        for a, b in SIDES.get(int(k), ()):
            following[x + mid[a][0], y + mid[a][1]] = (x + mid[b][0], y + mid[b][1])
    out = []
    while following:
        start = min(following)
        ring, at = [start], following.pop(start)
        while at != start and at in following:
            ring.append(at)
            at = following.pop(at)
        ring.append(start)
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
        out.append((int(p["src"].iloc[0]), [list(map(float, v)) for v in ring], float(area)))
    return pd.DataFrame(out, columns=["src", "ring", "area"])


def interpolated(rings: DataFrame, raster: DataFrame) -> DataFrame:
    """rings (src, value, ring, area) with points where the cost equals value, linearly between the two cells beside a point.

    A point stays in the middle where a cell has no cost; it never leaves the line between the cells' corners.
    """
    at = raster.select("src", "x", "y", F.col("value").alias("cost"))
    spots = rings.withColumn("_r", F.monotonically_increasing_id()).select("_r", "src", "value", "area", F.posexplode("ring").alias("i", "p"))
    ends = spots.select("*", *(f(F.col("p")[k]).cast("int").alias(f"{n}{k}") for n, f in (("a", F.floor), ("b", F.ceil)) for k in (0, 1)))
    for n in "ab":
        ends = ends.join(at.select("src", F.col("x").alias(f"{n}0"), F.col("y").alias(f"{n}1"), F.col("cost").alias(f"{n}v")), ["src", f"{n}0", f"{n}1"], "left")
    part = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("av")) / F.nullif(F.col("bv") - F.col("av"), F.lit(0)))), F.lit(0.5))
    part = F.when(F.col("av").isNull() | F.col("bv").isNull(), 0.5).otherwise(part)
    moved = ends.select("_r", "src", "value", "area", "i", F.array(*(F.col(f"a{k}") + part * (F.col(f"b{k}") - F.col(f"a{k}")) for k in (0, 1))).alias("p"))
    listed = moved.groupBy("_r", "src", "value", "area").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("l"))
    return listed.select("src", "value", F.col("l.p").alias("ring"), "area")


def polygons(rings: DataFrame, *by: str) -> DataFrame:
    """(*by, rings, area): each outer ring with its holes; by is src and what else names an isochrone.

    A hole belongs to the outer ring of fewest points that contains its first point. Rings of an isochrone are compared with one another
    only, a task of its own.
    """
    schema = ", ".join(f"{c} {dict(rings.dtypes)[c]}" for c in by) + ", rings array<array<array<double>>>, area double"
    return rings.select(*by, "ring", "area").groupBy(*by).applyInPandas(lambda p: _with_holes(p, by), schema)


def _with_holes(p: pd.DataFrame, by: tuple) -> pd.DataFrame:
    outer = sorted(([[list(v) for v in r] for r in [ring]], area) for ring, area in zip(p["ring"], p["area"], strict=True) if area > 0)
    for ring, area in zip(p["ring"], p["area"], strict=True):
        around = [o for o in outer if area <= 0 and _contains(o[0][0], ring[0])]
        if around:
            min(around, key=lambda o: len(o[0][0]))[0].append([list(v) for v in ring])
    keys = p[list(by)].iloc[:1]
    return pd.concat([keys.assign(rings=[rings], area=area) for rings, area in outer] or [pd.DataFrame(columns=[*by, "rings", "area"])])


def _contains(ring: list, point) -> bool:
    x, y = point
    sides = zip(ring, ring[1:], strict=False)
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides) % 2 == 1


def in_degrees(rings, size: float):
    """Rings of cell coordinates as rings of (lon, lat): a cell's value stands at its centre."""
    point = lambda p: F.array(*from_mercator((p[0] + 0.5) * F.lit(float(size)), (p[1] + 0.5) * F.lit(float(size))))
    return F.transform(rings, lambda r: F.transform(r, point))
