"""Range join, projection and tile queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import geo as G
from sidetrace.operators import relate as O
from sidetrace.operators import sides, tiles
from sidetrace.operators.rangejoin import box_join, box_join_with_tolerance, interval_join, merged_intervals
from sidetrace.plans.base import Registry, table
from sidetrace.plans.schedules import LAT, LON

R = Registry()
_BOX = f"{LON} AS min_x, {LAT} AS min_y, {LON} + CAST({{k}} % 9 AS DOUBLE) / 1024.0 AS max_x, {LAT} + CAST({{k}} % 7 AS DOUBLE) / 1024.0 AS max_y"


def _boxes(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(f"{key} AS id", *(_BOX.format(k=key).split(", ")))


def _box_sql(name: str, key: str) -> str:
    return f"(SELECT {key} AS id, {_BOX.format(k=key)} FROM {name})"


@R.add(f"SELECT id FROM {_box_sql('customer', 'c_custkey')} WHERE max_x >= -74.25 AND min_x <= -74.0 AND max_y >= 40.5 AND min_y <= 40.75")
def q_bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, "customer", "c_custkey").where(G.intersects(None, -74.25, 40.5, -74.0, 40.75)).select("id")


@R.add(f"SELECT a.id AS l_id, b.id AS r_id FROM {_box_sql('customer', 'c_custkey')} a JOIN {_box_sql('supplier', 's_suppkey')} b ON a.max_x >= b.min_x AND a.min_x <= b.max_x AND a.max_y >= b.min_y AND a.min_y <= b.max_y")
def q_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_join(_boxes(spark, sf_dir, "customer", "c_custkey"), _boxes(spark, sf_dir, "supplier", "s_suppkey"), 1 / 64).select("l_id", "r_id")


@R.add("SELECT a.c_custkey AS l_id, b.s_suppkey AS r_id FROM customer a JOIN supplier b ON c_nationkey = s_nationkey AND c_acctbal <= s_acctbal + 200 AND s_acctbal <= c_acctbal + 100")
def q_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 100).alias("hi"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 200).alias("hi"))
    return interval_join(a, b, 500.0, on=("k",)).select("l_id", "r_id")


_EXACT = f"SELECT a.id AS l_id, b.id AS r_id FROM {_box_sql('supplier', 's_suppkey')} a JOIN {_box_sql('part', 'p_partkey')} b ON a.max_x >= b.min_x AND a.min_x <= b.max_x AND a.max_y >= b.min_y AND a.min_y <= b.max_y"
_PAD = "0.015625"


@R.add(f"WITH e AS ({_EXACT}) SELECT l_id, r_id, 'false' AS used_tolerance FROM e UNION ALL SELECT a.id, b.id, 'true' FROM {_box_sql('supplier', 's_suppkey')} a JOIN {_box_sql('part', 'p_partkey')} b ON a.max_x + {_PAD} >= b.min_x AND a.min_x - {_PAD} <= b.max_x AND a.max_y + {_PAD} >= b.min_y AND a.min_y - {_PAD} <= b.max_y WHERE a.id NOT IN (SELECT l_id FROM e)")
def q_tolerance_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact pass, and a padded one for those that it left without a partner."""
    a, b = _boxes(spark, sf_dir, "supplier", "s_suppkey"), _boxes(spark, sf_dir, "part", "p_partkey")
    return box_join_with_tolerance(a, b, 1 / 64, float(_PAD), "id").select("l_id", "r_id", F.col("used_tolerance").cast("string").alias("used_tolerance"))


@R.add("SELECT a.s_nationkey AS side, a.s_suppkey AS first, b.s_suppkey AS second FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND (a.s_acctbal > 5000) <> (b.s_acctbal > 5000) AND least(a.s_acctbal, b.s_acctbal) + 3000 - greatest(a.s_acctbal, b.s_acctbal) > 0.000001")
def q_pair_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as spans of 3000 whose signs differ and that share a stretch."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("side"), F.col("s_suppkey").alias("frequency_row"), (F.col("s_acctbal") > 5000).alias("signature"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 3000).alias("hi"))
    return sides.conflicts(s, ["side"])


def _tile_sql(lon: str, lat: str, z: str) -> tuple[str, str]:
    n = f"pow(2.0, {z})"
    return f"CAST(greatest(0, least(floor(({lon} + 180.0) / 360.0 * {n}), {n} - 1)) AS BIGINT)", f"CAST(greatest(0, least(floor((1.0 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2.0 * {n}), {n} - 1)) AS BIGINT)"


_TX, _TY = _tile_sql("lon", "lat", "z")
_POINTS = f"(SELECT c_custkey, {LON.format(k='c_custkey')} + 0.0001 AS lon, {LAT.format(k='c_custkey')} + 0.0001 AS lat FROM customer)"


@R.add(f"SELECT c_custkey, z, {_TX} AS x, {_TY} AS y FROM {_POINTS}, (VALUES (12), (14), (17)) v(z)")
def q_tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{LON.format(k='c_custkey')} + 0.0001 AS lon", f"{LAT.format(k='c_custkey')} + 0.0001 AS lat", "explode(array(12, 14, 17)) AS z")
    x, y = G.tile_xy(F.col("lon"), F.col("lat"), F.col("z"))
    return p.select("c_custkey", "z", x.alias("x"), y.alias("y"))


_CX0, _CY1 = _tile_sql("min_x - 0.0005", "min_y - 0.0005", "14")
_CX1, _CY0 = _tile_sql("max_x + 0.0005", "max_y + 0.0005", "14")


@R.add(f"SELECT id, x, y FROM (SELECT id, unnest(range({_CX0}, {_CX1} + 1)) AS x, y0, y1 FROM (SELECT *, {_CY0} AS y0, {_CY1} AS y1 FROM {_box_sql('customer', 'c_custkey')})), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)")
def q_tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.cover(_boxes(spark, sf_dir, "customer", "c_custkey"), (14,), pad_degrees=0.0005).select("id", "x", "y")


@R.add("SELECT coalesce(o_orderpriority, 'ALL') AS zoom, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS largest, CAST(quantile_disc(CAST(o_totalprice AS BIGINT), 0.95) AS BIGINT) AS p95 FROM (SELECT o_orderpriority, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY GROUPING SETS ((o_orderpriority), ())")
def q_tile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("zoom"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return tiles.size_metrics(o, "zoom", "bytes")


_SEEN = f"(SELECT c_custkey, z FROM customer, (VALUES (12), (13), (14)) v(z) WHERE c_mktsegment <> CASE z WHEN 12 THEN 'BUILDING' WHEN 13 THEN 'MACHINERY' ELSE '' END)"


@R.add(f"SELECT z, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n_features, CAST((SELECT count(*) FROM customer) - count(DISTINCT c_custkey) AS BIGINT) AS n_missing FROM {_SEEN} GROUP BY z")
def q_zoom_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as features, of which two zooms lack a segment."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"), "c_mktsegment")
    z = c.select("feature_id", "c_mktsegment", F.explode(F.array(F.lit(12), F.lit(13), F.lit(14))).alias("z"))
    return tiles.zoom_coverage(c, z.where(F.col("c_mktsegment") != F.when(F.col("z") == 12, "BUILDING").when(F.col("z") == 13, "MACHINERY").otherwise("")))


_SPAN, _EDGE = "(2 * pi() * 6378137.0 / pow(2.0, 14))", "(pi() * 6378137.0)"
_CELL = f"round_even((x - (4800 * {_SPAN} - {_EDGE})) / {_SPAN} * 4096, 0)"


@R.add(f"SELECT c_custkey, CASE WHEN {_CELL.replace('(x -', '(x0 -')} <> {_CELL.replace('(x -', '(x1 -')} THEN 'true' ELSE 'false' END AS survives FROM (SELECT c_custkey, 4800 * {_SPAN} - {_EDGE} + CAST((c_custkey * 13) % 512 AS DOUBLE) / 8.0 AS x0, 4800 * {_SPAN} - {_EDGE} + CAST((c_custkey * 13) % 512 AS DOUBLE) / 8.0 + CAST(c_custkey % 3 AS DOUBLE) / 4.0 AS x1 FROM customer)")
def q_quantize_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level lines of 0, 0.25 or 0.5 m in one tile of zoom 14, whose grid is 0.6 m wide."""
    span, edge = 2 * math.pi * 6378137.0 / 2.0**14, math.pi * 6378137.0
    k = F.col("c_custkey")
    x0 = F.lit(4800 * span - edge) + (k * 13 % 512).cast("double") / 8.0
    line = F.array(F.struct(x0.alias("x"), F.lit(edge - 6000 * span).alias("y")), F.struct((x0 + (k % 3).cast("double") / 4.0).alias("x"), F.lit(edge - 6000 * span).alias("y")))
    return table(spark, sf_dir, "customer").select("c_custkey", G.survives(F.array(line), 14, F.lit(4800), F.lit(6000)).cast("string").alias("survives"))


@R.add(
    """WITH i AS (SELECT user_id, event_id % 5000 AS lo, event_id % 5000 + 20 + event_id % 30 AS hi FROM events),
    g AS (SELECT *, CASE WHEN max(hi) OVER w >= lo THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM g),
    m AS (SELECT user_id, island, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY 1, 2)
    SELECT user_id, CAST(count(*) AS BIGINT) AS n_islands, CAST(sum(hi - lo) AS BIGINT) AS covered FROM m GROUP BY 1"""
)
def q_running_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 5000 AS lo", "event_id % 5000 + 20 + event_id % 30 AS hi")
    return merged_intervals(i, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n_islands"), F.sum(F.col("hi") - F.col("lo")).alias("covered"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bent line of three points for each customer, in state plane feet."""
    k = F.col("c_custkey")
    x, y = (k * 37 % 1000 * 100).cast("double") + 900000, (k * 91 % 800 * 100).cast("double") + 150000
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    line = F.array(point(F.lit(0.0), F.lit(0.0)), point(F.lit(150.0), (k % 5 * 10).cast("double")), point(F.lit(300.0), (k % 7 * 20).cast("double")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array(line).alias("lines"))


@R.add()
def k_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sides.offset_traces(_lines(spark, sf_dir).withColumn("side", F.when(F.col("c_custkey") % 2 == 0, "LEFT").otherwise("RIGHT")), ["c_custkey", "side"])
    return t.select("c_custkey", "side", "used_offset", "strategy", F.round("trace_length", 6).alias("trace_length"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("feature_id"), F.lit("faces").alias("layer"), G.project(F.col("lines"), lambda a, b: G.plane_to_lonlat(a, b)).alias("lines"), F.create_map(F.lit("n"), F.col("c_custkey").cast("string")).alias("props"))


@R.add()
def k_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tile_features(_features(spark, sf_dir), tuple(range(vocab.MIN_ZOOM, vocab.MAX_ZOOM + 1))).select("z", "x", "y", "feature_id", F.size("lines").alias("n_parts"))


_AREA = "abs(({x1} - {x0}) * ({y2} - {y0}) - ({x2} - {x0}) * ({y1} - {y0}))".format(x0="0", y0="0", x1="150", y1="(c_custkey % 5 * 10)", x2="300", y2="(c_custkey % 7 * 20)")


@R.add(f"SELECT c_custkey, CAST(CASE WHEN {_AREA} / sqrt(300.0 * 300.0 + pow(c_custkey % 7 * 20, 2)) > 30 THEN 3 ELSE 2 END AS INT) AS n_points FROM customer")
def k_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three points: the middle one stays if it is farther from the chord than the tolerance."""
    lines = _lines(spark, sf_dir)
    return lines.select("c_custkey", F.size(F.flatten(tiles.simplify_column(F.col("lines"), F.lit(30.0)))).alias("n_points"))


@R.add()
def k_mvt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.build_tiles(_features(spark, sf_dir)).select("z", "x", "y", "n_features", "raw_bytes", F.length("data").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@R.add(f"SELECT feature_id, CAST(count(*) AS BIGINT) AS n_zooms FROM (SELECT CAST(c_custkey AS VARCHAR) AS feature_id, unnest(range({vocab.MIN_ZOOM}, {vocab.MAX_ZOOM + 1})) AS z FROM customer) GROUP BY 1")
def k_tiles_hold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded tiles read back: every line is met at every zoom, and what a tile says of it is what went in (a false property would leave its row out)."""
    seen = tiles.decode_tiles(tiles.build_tiles(_features(spark, sf_dir))).where(F.col("props")["n"] == F.col("feature_id"))
    return O.distinct_counts(seen, "feature_id", "z").select("feature_id", F.col("n").alias("n_zooms"))


@R.add("SELECT count(*) AS n, 0 AS n_broken FROM customer")
def k_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to longitude and latitude and back to the plane: none moves by a thousandth of a foot."""
    there = _lines(spark, sf_dir).select("lines", G.project(G.project(F.col("lines"), G.plane_to_lonlat), G.lonlat_to_plane).alias("back"))
    moved = F.exists(F.arrays_zip(F.flatten("lines").alias("a"), F.flatten("back").alias("b")), lambda p: (F.abs(p["a"]["x"] - p["b"]["x"]) > 1e-3) | (F.abs(p["a"]["y"] - p["b"]["y"]) > 1e-3))
    return there.agg(F.count("*").alias("n"), F.count_if(moved).cast("int").alias("n_broken"))
