"""Sinks: canonical features, records that need a look, tile archives and their metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.operators import tiles as T


def write_features(features: DataFrame, path: str) -> None:
    """One canonical JSON object a line, in key order: the same features give the same lines."""
    names = sorted(features.columns)
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    features.select("feature_key", body.alias("value")).orderBy("feature_key").select("value").write.mode("errorifexists").text(path)


def audit_records(sides: DataFrame) -> DataFrame:
    """Sides that didn't match, or whose trace needed another distance or strategy."""
    return sides.where((F.col("outcome") != "matched") | (F.col("used_offset") != vocab.OFFSET_FEET) | (F.col("strategy") != "continuous_line_offset")).select("source_row", "side", "outcome", "reason", "technical_identity", "trace_length", "covered", "coverage_ratio", "used_offset", "strategy")


def write_archive(tiles: DataFrame, path: str) -> None:
    """Tiles partitioned by zoom, with the row number counted from the south beside y."""
    tiles.withColumn("tms_row", T.tms_row(F.col("z"), F.col("y"))).repartition("z", F.shiftright("x", 4)).sortWithinPartitions("z", "x", "y").write.mode("errorifexists").partitionBy("z").parquet(path)


def data_updated(schedules: DataFrame) -> str:
    """The latest time of retrieval, as text; empty without rows."""
    return schedules.agg(F.max("retrieved_at")).first()[0] or ""


#: Keys of a tile archive's metadata whose values are whole numbers. Fixed values.
WHOLE = ("minzoom", "maxzoom", "unknown_minzoom", "extent", "buffer_pixels", "max_tile_bytes", "max_raw_tile_bytes", "feature_count", "unknown_feature_count", "tile_count", "tile_bytes", "tile_bytes_max", "tile_bytes_p95", "raw_bytes", "raw_bytes_max", "raw_bytes_p95")


def archive_metadata(tiles: DataFrame, faces: DataFrame, version: str, zooms: tuple[int, ...] | None = None, **more: object) -> DataFrame:
    """Rows (name, value) of a tile archive: form, zooms, bounds, layers, counts and sizes, over all and by zoom, and what else is told."""
    spark = tiles.sparkSession
    zooms = zooms or tuple(range(vocab.MIN_ZOOM, vocab.MAX_ZOOM + 1))
    box = faces.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y"), F.count("*")).first()
    sized = tiles.select("z", F.length("data").cast("long").alias("b"), "raw_bytes")
    sizes, raw = ({r["z"]: r for r in T.size_metrics(sized, "z", c).collect()} for c in ("b", "raw_bytes"))
    zero = {"n": 0, "total": 0, "largest": 0, "p95": 0}
    whole, whole_raw = sizes.get("ALL", zero), raw.get("ALL", zero)
    by_zoom = {z: {"tiles": r["n"], "bytes": r["total"], "largest": r["largest"], "p95": r["p95"], "raw_largest": raw[z]["largest"]} for z, r in sorted(sizes.items()) if z != "ALL"}
    layers = [{"id": "faces", "minzoom": min(zooms), "maxzoom": max(zooms)}, {"id": "unknown", "minzoom": max(min(zooms), vocab.UNKNOWN_ZOOM), "maxzoom": max(zooms)}]
    centre = ",".join(f"{(box[i] + box[i + 2]) / 2:.6f}" for i in (0, 1)) + f",{min(zooms)}" if box[4] else ""
    rows = {
        "name": "streets", "description": "street sides and their collection days", "type": "overlay", "version": version, "format": "pbf", "compression": "gzip", "scheme": "tms", "minzoom": min(zooms), "maxzoom": max(zooms),
        "unknown_minzoom": vocab.UNKNOWN_ZOOM, "extent": vocab.EXTENT, "buffer_pixels": vocab.TILE_BUFFER_PIXELS, "max_tile_bytes": vocab.MAX_TILE_BYTES, "max_raw_tile_bytes": vocab.MAX_RAW_TILE_BYTES,
        "bounds": ",".join(f"{v:.6f}" for v in box[:4]) if box[4] else "", "center": centre, "json": json.dumps({"vector_layers": layers}, sort_keys=True), "feature_count": box[4], "unknown_feature_count": 0,
        "tile_count": whole["n"], "tile_bytes": whole["total"], "tile_bytes_max": whole["largest"], "tile_bytes_p95": whole["p95"], "raw_bytes": whole_raw["total"], "raw_bytes_max": whole_raw["largest"], "raw_bytes_p95": whole_raw["p95"],
        "zoom_metrics": json.dumps(by_zoom, sort_keys=True), **more,
    }
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(rows.items())], "name string, value string")


class MetadataError(ValueError):
    """Metadata that lacks a key, repeats one, or has a value of another type."""


def whole_number(values: dict[str, str], key: str) -> int:
    text = values.get(key)
    if text is None or not text.isascii() or not text.isdigit():
        raise MetadataError(f"{key} is no whole number")
    return int(text)


def json_object(values: dict[str, str], key: str) -> dict:
    try:
        found = json.loads(values.get(key) or "")
    except ValueError as e:
        raise MetadataError(f"{key} is no JSON") from e
    if not isinstance(found, dict):
        raise MetadataError(f"{key} is no JSON object")
    return found


def read_metadata(metadata: DataFrame) -> dict:
    """The values of an archive's metadata, typed and checked: bounds in order, zooms within limits, layers named."""
    rows = metadata.limit(1000).collect()
    values = {r["name"]: r["value"] for r in rows}
    if len(values) != len(rows):
        raise MetadataError("a key is repeated")
    out: dict = {**values, **{k: whole_number(values, k) for k in WHOLE}, "json": json_object(values, "json"), "zoom_metrics": json_object(values, "zoom_metrics")}
    try:
        out["bounds"] = tuple(float(x) for x in values["bounds"].split(",")) if values.get("bounds") else None
    except ValueError as e:
        raise MetadataError("bounds are no numbers") from e
    if out["bounds"] is not None and not (len(out["bounds"]) == 4 and -180 <= out["bounds"][0] <= out["bounds"][2] <= 180 and -90 <= out["bounds"][1] <= out["bounds"][3] <= 90):
        raise MetadataError("bounds are out of range or order")
    if not vocab.MIN_ZOOM <= out["minzoom"] <= out["maxzoom"] or values.get("format") != "pbf" or values.get("scheme") != "tms":
        raise MetadataError("zooms or form are unknown")
    return out


#: Where a store says its source's version, first found first. Fixed values.
VERSION_KEYS = ("release_version", "dataset_version", "source_sha256", "retrieved_at")


def source_version(explicit: str | None, metadata: DataFrame, digest: str) -> str:
    """The version of a store: the one given, else the first of the metadata's keys that has a value, else its digest."""
    if explicit:
        return explicit
    values = {r["name"]: r["value"] for r in metadata.where(F.col("name").isin(*VERSION_KEYS)).collect()}
    return next((values[k] for k in VERSION_KEYS if values.get(k)), digest)


def upsert(metadata: DataFrame, values: dict[str, str]) -> DataFrame:
    """Metadata rows with these values put in place of those of the same names."""
    new = metadata.sparkSession.createDataFrame(sorted(values.items()), "name string, value string")
    return metadata.join(F.broadcast(new.select("name")), "name", "left_anti").select("name", "value").union(new)
