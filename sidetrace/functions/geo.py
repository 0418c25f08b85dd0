"""Geometry measures and projections as Column expressions over ARRAY<ARRAY<STRUCT<x, y>>> lines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_R = 6378137.0
# The published New York Long Island state plane zone (GRS80, US survey feet).
_A, _F = 6378137.0, 1 / 298.257222101
_FOOT = 1200 / 3937
_P1, _P2, _P0, _L0 = (math.radians(x) for x in (40 + 40 / 60, 41 + 2 / 60, 40 + 10 / 60, -74.0))
_FALSE_X = 300000.0
_E = math.sqrt(2 * _F - _F * _F)


def _t(p: float) -> float:
    s = _E * math.sin(p)
    return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _m(p: float) -> float:
    return math.cos(p) / math.sqrt(1 - (_E * math.sin(p)) ** 2)


_N = (math.log(_m(_P1)) - math.log(_m(_P2))) / (math.log(_t(_P1)) - math.log(_t(_P2)))
_C = _m(_P1) / (_N * _t(_P1) ** _N)
_RHO0 = _A * _C * _t(_P0) ** _N


def plane_to_lonlat(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """Longitude and latitude of state plane feet (inverse Lambert conformal conic; NAD83 taken as WGS84)."""
    dx, dy = x * _FOOT - _FALSE_X, F.lit(_RHO0) - y * _FOOT
    rho = F.sqrt(dx * dx + dy * dy)
    lon = F.degrees(F.atan2(dx, dy) / _N + _L0)
    t = F.pow(rho / (_A * _C), F.lit(1 / _N))
    p = F.lit(math.pi / 2) - 2 * F.atan(t)
    # the series in the isometric latitude's doubled angles; exact to about 1e-11 degrees
    e2, e4, e6, e8 = _E**2, _E**4, _E**6, _E**8
    lat = p + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * p) + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * p) + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * p) + (4279 * e8 / 161280) * F.sin(8 * p)
    return lon, F.degrees(lat)


def lonlat_to_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    p = F.radians(lat)
    s = _E * F.sin(p)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    rho = _A * _C * F.pow(t, F.lit(_N))
    theta = _N * (F.radians(lon) - _L0)
    return (rho * F.sin(theta) + _FALSE_X) / _FOOT, (_RHO0 - rho * F.cos(theta)) / _FOOT


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _R, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * _R


def tile_xy(lon: Column, lat: Column, z: Column | int) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point, clamped to the grid."""
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    p = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2.0 * n)
    top = n.cast("long") - 1
    return F.greatest(F.lit(0), F.least(x, top)).cast("long"), F.greatest(F.lit(0), F.least(y, top)).cast("long")


def project(lines: Column, to) -> Column:
    """Applies a projection (x, y) -> (x, y) to all points of lines."""

    def point(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(lines, lambda line: F.transform(line, point))


def project_polygons(polys: Column, to) -> Column:
    """project for polygons (polygon, ring, point)."""
    return F.transform(polys, lambda rings: project(rings, to))


def is_lonlat(points: Column) -> Column:
    """Whether points all lie in the range of longitude and latitude; plane feet of any place in the zone don't."""
    return F.forall(points, lambda p: (F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90))


def longest(lines: Column) -> Column:
    """The longest line, the first of equals."""
    pairs = F.transform(lines, lambda line, i: F.struct(length(F.array(line)).alias("l"), (-i).alias("i"), line.alias("line")))
    return F.array_max(F.transform(pairs, lambda p: F.struct(p["l"], p["i"], p["line"])))["line"]


def length(lines: Column) -> Column:
    """Total length of all lines."""
    steps = lambda line: F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(F.flatten(F.transform(lines, steps)), F.lit(0.0), lambda s, d: s + d)


def bounds(lines: Column) -> Column:
    """STRUCT(min_x, min_y, max_x, max_y)."""
    points = F.flatten(lines)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def intersects(a: Column | None, west: Column | float, south: Column | float, east: Column | float, north: Column | float) -> Column:
    """Whether a bounds struct, or the columns min_x to max_y of a row, meet a box, edges included."""
    side = (lambda c: a[c]) if a is not None else F.col
    return (side("max_x") >= west) & (side("min_x") <= east) & (side("max_y") >= south) & (side("min_y") <= north)


def reverse_lines(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.reverse(line))


def line_error(lines: Column) -> Column:
    """Why lines are no usable geometry, or null."""
    finite = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < 1e300) & (F.abs(p["y"]) < 1e300)
    return (
        F.when(lines.isNull() | (F.size(lines) == 0), "missing or empty geometry")
        .when(F.exists(lines, lambda line: F.size(line) < 2) | ~F.forall(F.flatten(lines), finite), "invalid line geometry")
        .when(length(lines) <= 0, "zero-length geometry")
    )


def combine(parts: Column) -> Column:
    """One array of lines from an array of arrays, exact repeats left out, first seen first."""
    return F.array_distinct(F.flatten(parts))


def geometry_key(lines: Column, row: Column) -> Column:
    """Equal for exactly equal geometries; a broken one equals itself alone."""
    return F.when(line_error(lines).isNull(), F.sha2(F.to_json(lines), 256)).otherwise(F.concat(F.lit("invalid:"), row.cast("string")))


def survives(lines: Column, z: Column | int, x: Column, y: Column, extent: int = 4096) -> Column:
    """Whether any Mercator point falls on another grid position of tile (z, x, y) than its line's first (half-even rounding)."""
    span = 2 * math.pi * _R / F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    west, north = x * span - math.pi * _R, math.pi * _R - y * span
    cell = lambda p: F.struct(F.bround((p["x"] - west) / span * extent).alias("a"), F.bround((north - p["y"]) / span * extent).alias("b"))
    return F.exists(lines, lambda line: F.exists(line, lambda p: cell(p) != cell(line[0])))
