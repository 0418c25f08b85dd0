"""Serving queries over versioned tables: streets by day, type and box; health; map configuration; tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import geo as G
from sidetrace.operators import relate as R
from sidetrace.operators import store


class BadRequest(ValueError):
    """A parameter is out of its vocabulary or range."""


class TooMany(RuntimeError):
    """A result is larger than its cap; a partial one is never returned."""


def check_day(day: str) -> str:
    day = day.strip().upper()
    if day not in vocab.DAYS:
        raise BadRequest(f"unknown day {day!r}")
    return day


def check_types(types: str | tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """Known types in the order given, each once."""
    asked = [t.strip().upper() for t in (types.split(",") if isinstance(types, str) else types)]
    if not asked or any(t not in vocab.TYPES for t in asked):
        raise BadRequest("unknown or empty collection types")
    return tuple(dict.fromkeys(asked))


def check_bounds(box: tuple[float, float, float, float] | None) -> tuple[float, float, float, float] | None:
    """(west, south, east, north): all or none, finite, in range and in order."""
    if box is None:
        return None
    if len(box) != 4 or any(v is None or v != v or abs(v) == float("inf") for v in box):
        raise BadRequest("bounds must be four finite numbers")
    west, south, east, north = box
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise BadRequest("bounds are out of range or order")
    return box


def streets(faces: DataFrame, schedules: DataFrame, day: str, types: str | tuple[str, ...] = ("REFUSE",), box: tuple[float, float, float, float] | None = None, cap: int | None = None) -> DataFrame:
    """Faces with a collection of one of the types on the day, and all days of that face and type, alphabetically.

    The box takes faces whose bounds meet it, edges included. Days are aggregated only for faces and types that match.
    With a cap, a larger result raises TooMany.
    """
    day, types, box = check_day(day), check_types(types), check_bounds(box)
    wanted = schedules.where(F.col("collection_type").isin(*types))
    days = store.day_lists(wanted).where(F.array_contains("weekdays", day))
    if box:
        west, south, east, north = box
        faces = faces.where(G.intersects(None, west, south, east, north))
    found = days.join(faces, "block_face_id")
    if cap is not None and R.over_cap(found, cap):
        raise TooMany(f"more than {cap} rows")
    return found


def collects_on(day_list: Column, day: str) -> Column:
    """Whether a comma-separated list of days, as tiles carry it, has the day; null and empty lists have none."""
    return F.array_contains(F.split(F.coalesce(day_list, F.lit("")), ","), check_day(day))


def health(schedules: DataFrame, states: DataFrame, unknown: DataFrame) -> DataFrame:
    """Rows (section, name, n): schedule rows by type, states by state, unknown faces by reason; known names are zero-filled."""
    spark = schedules.sparkSession
    every = spark.createDataFrame([("type", t) for t in vocab.TYPES] + [("state", s) for s in vocab.STATES], "section string, name string")
    parts = [(schedules, "type", "collection_type"), (states, "state", "state"), (unknown, "reason", "reason_code")]
    counts = [R.counts_by(df, c, "name").select(F.lit(s).alias("section"), "name", "n") for df, s, c in parts]
    return every.join(counts[0].union(counts[1]).union(counts[2]), ["section", "name"], "full_outer").select("section", "name", F.coalesce("n", F.lit(0)).alias("n"))


def map_config(version: str | None, bounds: tuple[float, float, float, float] | None, updated: str | None = None) -> dict:
    """What a map client needs; without a version the map is unavailable."""
    if version is None:
        return {"available": False, "version": None, "tiles": None}
    return {"available": True, "version": version, "tiles": f"/api/tiles/{version}/{{z}}/{{x}}/{{y}}.pbf", "minzoom": vocab.MIN_ZOOM, "maxzoom": vocab.MAX_ZOOM, "unknown_minzoom": vocab.UNKNOWN_ZOOM, "bounds": list(bounds) if bounds else None, "data_updated": updated}


def tile(tiles: DataFrame, z: int, x: int, y: int) -> bytes | None:
    """One tile's bytes or None; the table is partitioned by z, so one folder is read."""
    if not vocab.MIN_ZOOM <= z <= vocab.MAX_ZOOM or not (0 <= x < 1 << z and 0 <= y < 1 << z):
        raise BadRequest("tile coordinates are out of range")
    row = tiles.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)).select("data").first()
    if row is None:
        return None
    if bytes(row[0][:2]) != b"\x1f\x8b":
        raise ValueError("a stored tile isn't gzip")
    return bytes(row[0])


def tile_response(tiles: DataFrame, current: str | None, version: str, z: int, x: int, y: int, if_none_match: str | None = None) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body) for one tile of a version: 503 without a release, 404 for another version or no such place, 304 for a known ETag, 204 for an empty tile.

    A version's tiles never change, so the ETag is made of version and place and answers may be kept for ever.
    """
    if current is None:
        return 503, {"Retry-After": "60"}, b""
    if version != current:
        return 404, {}, b""
    headers = {"ETag": f'"{version}-{z}-{x}-{y}"', "Cache-Control": "public, max-age=31536000, immutable"}
    asked = {t.strip().removeprefix("W/") for t in (if_none_match or "").split(",")}
    try:
        if headers["ETag"] in asked or "*" in asked:
            return 304, headers, b""
        data = tile(tiles, z, x, y)
    except BadRequest:
        return 404, {}, b""
    return (204, headers, b"") if data is None else (200, headers | {"Content-Type": "application/vnd.mapbox-vector-tile", "Content-Encoding": "gzip"}, data)


def with_state(column: Column, *states: str) -> Column:
    """The layer filter by state or reason: whether a feature's value is one of those shown."""
    return F.coalesce(column.isin(*states), F.lit(False))
