"""Zoom-level vector tiles: cover, simplify, clip, quantize, encode, metrics and checks."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import geo as G
from sidetrace.operators import kernels as K
from sidetrace.operators import relate as R

LINES = "array<array<struct<x:double,y:double>>>"
_HALF = math.pi * 6378137.0


def cover(boxes: DataFrame, zooms: tuple[int, ...], pad_degrees: float = 0.0) -> DataFrame:
    """Rows (..., z, x, y) of every tile that a padded lon/lat box may touch."""
    z = boxes.withColumn("z", F.explode(F.array(*(F.lit(k) for k in zooms))))
    x0, y1 = G.tile_xy(F.col("min_x") - pad_degrees, F.col("min_y") - pad_degrees, F.col("z"))
    x1, y0 = G.tile_xy(F.col("max_x") + pad_degrees, F.col("max_y") + pad_degrees, F.col("z"))
    return z.withColumn("_y", F.sequence(y0, y1)).withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode("_y")).drop("_y")


def _points(lines) -> list[K.Line]:
    return [[(p["x"], p["y"]) for p in line] for line in lines]


def simplify_column(lines: Column, tolerance: Column) -> Column:
    @F.pandas_udf(LINES)
    def run(ls: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [[{"x": a, "y": b} for a, b in K.simplify(line, t)] for line in _points(x)] for x, t in zip(ls, ts, strict=True)])

    return run(lines, tolerance)


def tile_features(features: DataFrame, zooms: tuple[int, ...], extent: int = vocab.EXTENT, buffer: int = vocab.TILE_BUFFER_PIXELS) -> DataFrame:
    """Rows (z, x, y, layer, feature_id, props, lines) of features (feature_id, layer, lines in lon/lat, props map) by tile.

    Lines are projected, simplified by half a pixel of 512, clipped to the tile and its buffer, and rounded half-even to the
    tile's grid; what falls on one grid point is gone. Features without lines, or whose layer is unknown below its zoom, are
    left out.
    """
    if buffer < vocab.TILE_BUFFER_PIXELS:
        raise ValueError("the tile buffer is too small")
    f = features.where(G.line_error(F.col("lines")).isNull()).withColumn("_b", G.bounds(F.col("lines"))).select("*", "_b.*").drop("_b")
    # a padded cover; the clip below decides
    pad = 360.0 / (1 << min(zooms)) * buffer / 512
    f = cover(f, zooms, pad).where((F.col("layer") != "unknown") | (F.col("z") >= vocab.UNKNOWN_ZOOM)).drop("min_x", "min_y", "max_x", "max_y")
    f = f.withColumn("lines", G.project(F.col("lines"), G.mercator))
    grid = "array<array<struct<x:int,y:int>>>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, x, y, lines in zip(*(batch[c].to_pylist() for c in ("z", "x", "y", "lines")), strict=True):
                span = 2 * _HALF / (1 << z)
                west, north = x * span - _HALF, _HALF - y * span
                room = span * buffer / 512
                parts = []
                for line in _points(lines):
                    for part in K.clip_to_box(K.simplify(line, span * 0.5 / 512), west - room, north - span - room, west + span + room, north + room):
                        cells = [(round((a - west) / span * extent), round((north - b) / span * extent)) for a, b in part]
                        if any(c != cells[0] for c in cells):
                            parts.append([{"x": a, "y": b} for a, b in cells])
                out.append(parts)
            keep = pa.array([bool(p) for p in out])
            kind = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
            names = ["z", "x", "y", "layer", "feature_id", "props"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out, kind)], names=[*names, "lines"]).filter(keep)

    return f.select("z", "x", "y", "layer", "feature_id", "props", "lines").mapInArrow(make, f"z int, x long, y long, layer string, feature_id string, props map<string,string>, lines {grid}")


def build_tiles(features: DataFrame, zooms: tuple[int, ...] = tuple(range(vocab.MIN_ZOOM, vocab.MAX_ZOOM + 1))) -> DataFrame:
    """Encoded tiles (z, x, y, data, raw_bytes, n_features): gzipped, byte for byte the same for the same features.

    A tile's features meet in one row; its size has a hard ceiling, and a tile over it fails the build.
    """
    t = tile_features(features, zooms)
    by_tile = t.groupBy("z", "x", "y").agg(F.array_sort(F.collect_list(F.struct("layer", "feature_id", F.array_sort(F.map_entries("props")).alias("props"), "lines"))).alias("f"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, raw, n = [], [], []
            for features in batch["f"].to_pylist():
                layers: dict[str, list] = defaultdict(list)
                for f in features:
                    layers[f["layer"]].append(([[(p["x"], p["y"]) for p in line] for line in f["lines"]], {"feature_id": f["feature_id"], **{e["key"]: e["value"] for e in f["props"] or []}}))
                tile = K.encode_tile(sorted(layers.items()))
                packed = K.pack_gzip(tile)
                if len(tile) > vocab.MAX_RAW_TILE_BYTES or len(packed) > vocab.MAX_TILE_BYTES:
                    raise ValueError("a tile is over its size ceiling")
                data.append(packed)
                raw.append(len(tile))
                n.append(len(features))
            yield pa.RecordBatch.from_arrays([batch["z"], batch["x"], batch["y"], pa.array(data, pa.binary()), pa.array(raw, pa.int64()), pa.array(n, pa.int64())], names=["z", "x", "y", "data", "raw_bytes", "n_features"])

    return by_tile.mapInArrow(make, "z int, x long, y long, data binary, raw_bytes long, n_features long")


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """Rows (z, x, y, layer, feature_id, props) of all features in encoded tiles; broken tiles raise."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("layer", pa.string()), ("feature_id", pa.string()), ("props", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            rows = []
            for z, x, y, data in zip(*(batch[c].to_pylist() for c in ("z", "x", "y", "data")), strict=True):
                for layer, features in K.decode_tile(K.unpack_gzip(data, vocab.MAX_RAW_TILE_BYTES)).items():
                    for _, props in features:
                        rows.append((z, x, y, layer, props.pop("feature_id", None), list(props.items())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return tiles.select("z", "x", "y", "data").mapInArrow(make, "z int, x long, y long, layer string, feature_id string, props map<string,string>")


def tms_row(z: Column, y: Column) -> Column:
    """The row number of an archive that counts from the south."""
    return F.pow(F.lit(2.0), z).cast("long") - 1 - y


def size_metrics(df: DataFrame, group: str, size: str) -> DataFrame:
    """Count, sum, maximum and nearest-rank 95th percentile by group and over all (group ALL).

    Sizes are counted first, so what is ranked by group is distinct sizes, not rows.
    """
    counts = df.groupBy(F.col(group).cast("string").alias(group), F.col(size).alias("s")).agg(F.count("*").alias("c"))
    both = counts.union(counts.groupBy(F.lit("ALL"), "s").agg(F.sum("c")))
    w = Window.partitionBy(group)
    ranked = both.select("*", F.sum("c").over(w.orderBy("s")).alias("upto"), F.sum("c").over(w).alias("n"))
    found = ranked.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("c")).alias("total"), F.max("s").alias("largest"), F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(0.95).cast("decimal(3,2)")), F.col("s"))).alias("p95"))
    return found.select(group, "n", "total", "largest", F.col("p95").cast("long").alias("p95"))


def zoom_coverage(features: DataFrame, tiled: DataFrame) -> DataFrame:
    """Rows (z, n_features, n_missing): how many features the tiles of each zoom hold, and how many they lack."""
    every = features.select("feature_id").distinct().count()
    return R.distinct_counts(tiled, "z", "feature_id").select("z", F.col("n").alias("n_features"), (F.lit(every) - F.col("n")).alias("n_missing"))


def lost_at_max_zoom(features: DataFrame, tiled: DataFrame, zoom: int = vocab.MAX_ZOOM) -> DataFrame:
    """Features that no tile of the largest zoom holds."""
    return features.select("feature_id").join(tiled.where(F.col("z") == zoom).select("feature_id").distinct(), "feature_id", "left_anti")
