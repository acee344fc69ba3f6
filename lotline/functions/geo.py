"""Coordinate arithmetic as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# WGS84 flattening and equatorial radius in metres.
FLATTENING = 1 / 298.257223563
EQUATOR_RADIUS_M = 6378137.0

# Fixed value: decimals kept in written coordinates.
COORDINATE_DECIMALS = 6


def to_fixed(x: Column, digits: int = COORDINATE_DECIMALS) -> Column:
    """``x`` rounded to ``digits`` decimals by its exact binary value, halves away from zero.

    Almost every value is settled by plain arithmetic. Only values too near a half for that,
    or very large, take the slow text path; there an exact tie is told apart by being a whole
    number of 2**-(digits + 1), the only binary fractions with that many decimals.
    """
    scale = float(10**digits)
    scaled = x * F.lit(scale)
    off_half = F.abs(F.abs(scaled - F.floor(scaled)) - F.lit(0.5))
    ticks = x * F.lit(float(2 ** (digits + 1)))
    return (
        F.when((F.abs(scaled) < F.lit(1e12)) & (off_half > F.lit(1e-3)), F.rint(scaled) / F.lit(scale))
        .when(ticks == F.floor(ticks), F.round(x, digits))
        .otherwise(F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double"))
    )


def round_nested(coordinates: Column, depth: int, digits: int = COORDINATE_DECIMALS) -> Column:
    """Round every number of a coordinate array nested ``depth`` levels deep."""
    if depth == 0:
        return to_fixed(coordinates, digits)
    return F.transform(coordinates, lambda inner: round_nested(inner, depth - 1, digits))


# Nesting depth of the coordinates of each geometry type.
GEOMETRY_DEPTH = {
    "Point": 1,
    "MultiPoint": 2,
    "LineString": 2,
    "MultiLineString": 3,
    "Polygon": 3,
    "MultiPolygon": 4,
}

def coordinates_of(geometry: Column, geometry_type: str) -> Column:
    """Coordinates of a geometry text as nested DOUBLE arrays."""
    depth = GEOMETRY_DEPTH[geometry_type]
    return F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<" * depth + "double" + ">" * depth)


# The coordinates member of a geometry text: digits, signs, commas and brackets.
_COORDINATES = r'"coordinates"\s*:\s*\[[-+0-9.eE,\[\]\s]*\]'


def round_geometry(df: DataFrame, geometry: str = "geometry", digits: int = COORDINATE_DECIMALS) -> DataFrame:
    """``df`` with the coordinates of its geometry texts rounded; other members stay as they are.

    NULL, geometry collections and geometries without coordinates pass unchanged. The steps are
    columns of their own so that each is computed once per row.
    """
    coordinates, rounded = F.col("_coordinates"), None
    for depth in sorted(set(GEOMETRY_DEPTH.values())):
        names = [n for n, d in GEOMETRY_DEPTH.items() if d == depth]
        numbers = F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
        text = F.to_json(round_nested(numbers, depth, digits))
        test = F.col("_type").isin(*names)
        rounded = F.when(test, text) if rounded is None else rounded.when(test, text)
    return (
        df.withColumn("_type", F.get_json_object(geometry, "$.type"))
        .withColumn("_member", F.regexp_extract(geometry, _COORDINATES, 0))
        .withColumn("_coordinates", F.substring("_member", F.instr("_member", "["), F.length("_member")))
        .withColumn("_rounded", F.when(F.col("_member") != "", rounded))
        .withColumn(
            geometry,
            F.when(F.col("_rounded").isNull(), F.col(geometry)).otherwise(
                F.replace(geometry, F.col("_member"), F.concat(F.lit('"coordinates":'), "_rounded"))
            ),
        )
        .drop("_type", "_member", "_coordinates", "_rounded")
    )


def polygons_of(geometry: Column) -> Column:
    """Polygon or MultiPolygon text as a list of polygons, each a list of rings; else NULL."""
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "Polygon", F.array(coordinates_of(geometry, "Polygon"))).when(
        kind == "MultiPolygon", coordinates_of(geometry, "MultiPolygon")
    )


@dataclass(frozen=True)
class Box:
    """Bounding box columns."""

    min_x: Column
    min_y: Column
    max_x: Column
    max_y: Column


def polygons_box(polygons: Column) -> Box:
    """Bounding box of a polygon list."""
    return _corners_box(F.flatten(F.transform(polygons, lambda rings: F.get(rings, 0))))


def _corners_box(corners: Column) -> Box:
    xs = F.transform(corners, lambda p: p[0])
    ys = F.transform(corners, lambda p: p[1])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def ring_edges(ring: Column) -> Column:
    """Edges of a closed ring: ``array<struct<x1,y1,x2,y2>>``."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")),
    )


def edge_side(x: Column, y: Column, edge: Column) -> Column:
    """Twice the area of edge and point: positive with the point to the left of the edge, 0 on its line."""
    return (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (edge["y2"] - edge["y1"]) * (x - edge["x1"])


def ray_meets(x: Column, y: Column, edge: Column) -> Column:
    """Whether a ray from the point towards growing x meets the edge, whose upper end does not count.

    An edge that goes up is met if the point is to its left, one that goes down if it is to its right.
    """
    side = edge_side(x, y, edge)
    up = (y >= edge["y1"]) & (y < edge["y2"]) & (side > 0)
    down = (y >= edge["y2"]) & (y < edge["y1"]) & (side < 0)
    return up | down


def touches_edge(x: Column, y: Column, edge: Column) -> Column:
    """Whether the point is on the edge: on its line and between its ends."""
    along_x = x.between(F.least(edge["x1"], edge["x2"]), F.greatest(edge["x1"], edge["x2"]))
    along_y = y.between(F.least(edge["y1"], edge["y2"]), F.greatest(edge["y1"], edge["y2"]))
    return along_x & along_y & (edge_side(x, y, edge) == 0)


def edges_cross(a: Column, b: Column) -> Column:
    """Whether two edges cross at a place that is an end of neither: each has its ends on both sides of the other."""

    def parted(by: Column, edge: Column) -> Column:
        first, last = (F.signum(edge_side(edge[x], edge[y], by)) for x, y in (("x1", "y1"), ("x2", "y2")))
        return first * last < 0

    return parted(a, b) & parted(b, a)


def mercator_x(lon: Column) -> Column:
    """Longitude on the unit square."""
    return lon / 360 + 0.5


def mercator_y(lat: Column) -> Column:
    """Latitude on the unit square, 0 at the top, clamped to [0, 1]."""
    s = F.sin(lat * math.pi / 180)
    # At the poles the logarithm has no finite value: NULL there, an end of the square here.
    y = 0.5 - 0.25 * F.ln((1 + s) / F.nullif(1 - s, F.lit(0.0))) / math.pi
    return (
        F.when(s >= 1, F.lit(0.0)).when(s <= -1, F.lit(1.0)).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)))
    )


def inverse_mercator_lon(x: Column) -> Column:
    return (x - 0.5) * 360


def inverse_mercator_lat(y: Column) -> Column:
    return 360 * F.atan(F.exp((180 - y * 360) * math.pi / 180)) / math.pi - 90


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """East-west and north-south metres per degree at a latitude on the WGS84 ellipsoid."""
    e2 = FLATTENING * (2 - FLATTENING)
    cos = F.cos(lat * (math.pi / 180))
    w2 = 1 / (1 - e2 * (1 - cos * cos))
    w = F.sqrt(w2)
    step = math.pi / 180 * EQUATOR_RADIUS_M
    return step * w * cos, step * w * w2 * (1 - e2)


def wrap_degrees(delta: Column) -> Column:
    """Longitude difference brought into [-180, 180], by whole turns: without branches, so that it is computed once."""
    return delta - F.lit(360.0) * F.rint(delta / 360.0)


def planar_metres(kx: Column, ky: Column, dlon: Column, dlat: Column) -> Column:
    dx = wrap_degrees(dlon) * kx
    dy = dlat * ky
    return F.sqrt(dx * dx + dy * dy)


def segment_metres(kx: Column, ky: Column, x: Column, y: Column, segment: Column) -> Column:
    """Metres from a point to the nearest place of a segment ``x1, y1, x2, y2``, planar at the given scale."""
    ux, uy = wrap_degrees(segment["x2"] - segment["x1"]) * kx, (segment["y2"] - segment["y1"]) * ky
    vx, vy = wrap_degrees(x - segment["x1"]) * kx, (y - segment["y1"]) * ky
    # How far along the segment; one without length has no such place, and its first end counts.
    t = F.least(F.greatest(F.try_divide(vx * ux + vy * uy, ux * ux + uy * uy), F.lit(0.0)), F.lit(1.0))
    return F.hypot(wrap_degrees((vx - t * ux) / kx) * kx, vy - t * uy)
