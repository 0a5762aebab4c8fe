"""Geometry as Column expressions: distances, projections, raster cells and containment."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in metres of the distance function, and of the web-mercator projection.
EARTH, MERCATOR = 6365000.0, 6378137.0


def f32(x) -> Column:
    """Round to single precision; applied after each operation, it equals single-precision arithmetic."""
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def haversine(lon_a, lat_a, lon_b, lat_b) -> Column:
    """Metres between two points in degrees."""
    rad = lambda x: f32(F.col(x) if isinstance(x, str) else x).cast("double") * F.lit(math.pi) / F.lit(180.0)
    d_lat, d_lon = rad(lat_b) - rad(lat_a), rad(lon_b) - rad(lon_a)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(rad(lat_a)) * F.cos(rad(lat_b)) * F.pow(F.sin(d_lon / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def line_length(line) -> Column:
    """Metres along an array of (lon, lat) structs; 0 for fewer than two points."""
    c = F.col(line) if isinstance(line, str) else line
    legs = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.when(F.size(c) < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))


def euclidean(x_a, y_a, x_b, y_b) -> Column:
    return F.hypot(x_a - x_b, y_a - y_b)


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(MERCATOR * math.pi / 180)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR) * F.log(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360)))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x * F.lit(180 / (MERCATOR * math.pi)), (F.atan(F.exp(y / F.lit(MERCATOR))) * 360 / F.lit(math.pi)) - 90


def cell(value: Column, size: float) -> Column:
    """Raster index; truncates toward zero."""
    return (value / F.lit(float(size))).cast("int")


def cell_square(x: Column, y: Column, size: float) -> Column:
    """Closed ring of a cell's five corners in degrees."""
    corner = lambda i, j: F.array(*from_mercator((x + i) * F.lit(float(size)), (y + j) * F.lit(float(size))))
    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))


def envelope(rings: list) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return min(xs), min(ys), max(xs), max(ys)


def in_envelope(x: Column, y: Column, rings: list) -> Column:
    """Strictly inside the bounding box: four comparisons that reach the scan."""
    a, b, c, d = envelope(rings)
    return (x > a) & (x < c) & (y > b) & (y < d)


def in_polygon(x: Column, y: Column, rings: list) -> Column:
    """Even-odd rule over all rings of a literal polygon, so that holes work."""
    crossings = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 == y2:
                continue
            at = F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
            crosses = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < at)
            crossings = crossings + F.when(crosses, 1).otherwise(0)
    return in_envelope(x, y, rings) & (crossings % 2 == 1)


def in_multipolygon(x: Column, y: Column, polygons: list) -> Column:
    out = F.lit(False)
    for rings in polygons:
        out = out | in_polygon(x, y, rings)
    return out


def signed_area(ring: Column) -> Column:
    """Twice the shoelace area of an array of (x, y) structs: positive for counter-clockwise rings."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.element_at(ring, i)["x"] * F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i % n + 1)["x"] * F.element_at(ring, i)["y"])


def resample(length: Column, step: float) -> Column:
    """Offsets 0, step, 2 step, ... up to a length, with the end itself."""
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor(length / step).cast("int")), lambda i: i * F.lit(float(step))), F.array(length)))


def along(start: Column, end: Column, length: Column, total: Column) -> Column:
    """Value at a length of an edge, truncated."""
    return (start + (end - start) * length / total).cast("int")
