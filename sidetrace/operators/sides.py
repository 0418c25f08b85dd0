"""The side-aware overlay: each side of each line is traced beside it and matched with the polygons that the trace meets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import geo as G
from sidetrace.functions import text as T
from sidetrace.operators import gates
from sidetrace.operators import kernels as K
from sidetrace.operators import prepare as P
from sidetrace.operators import relate as R
from sidetrace.operators.rangejoin import box_join, interval_join, merged_intervals

_LINES = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_LINES_SQL = "array<array<struct<x:double,y:double>>>"
#: Cells of the overlay's grid, in feet: about the extent of a long block.
CELL = 2000.0
#: Rows of polygons without their shapes that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 20_000


def _plain(lines) -> list[K.Line]:
    return [[(p["x"], p["y"]) for p in line] for line in lines]


def _rows(lines: list[K.Line]) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in line] for line in lines]


def offset_traces(df: DataFrame, keys: list[str], distance: float = vocab.OFFSET_FEET) -> DataFrame:
    """Rows (keys, sources, traces, trace_length, requested, used_offset, strategy, error, bounds) for rows (keys, side, lines)."""
    fields = [f for f in df.schema if f.name in keys]
    names = [f.name for f in fields]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for side, lines in zip(batch["side"].to_pylist(), batch["lines"].to_pylist(), strict=True):
                try:
                    pairs, _, used, strategy = K.side_traces(_plain(lines or []), side, distance)
                    traces = [t for _, t in pairs]
                    xs, ys = [x for t in traces for x, _ in t], [y for t in traces for _, y in t]
                    out.append((_rows([s for s, _ in pairs]), _rows(traces), sum(map(K.length, traces)), used, strategy, None, min(xs), min(ys), max(xs), max(ys)))
                except (ValueError, TypeError) as e:
                    out.append((None, None, None, None, None, str(e), None, None, None, None))
            kinds = [_LINES, _LINES, pa.float64(), pa.float64(), pa.string(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=[*names, "sources", "traces", "trace_length", "used_offset", "strategy", "error", "min_x", "min_y", "max_x", "max_y"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(*dict.fromkeys([*names, "side", "lines"])).mapInArrow(make, f"{schema}, sources {_LINES_SQL}, traces {_LINES_SQL}, trace_length double, used_offset double, strategy string, error string, min_x double, min_y double, max_x double, max_y double")


def overlaps(traces: DataFrame, polys: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Rows (source_row, side, frequency_row, part, lo, hi, source_lo, source_hi): where trace parts lie in polygons.

    Candidates come from a grid join of boxes; the exact clip runs only on them. Pieces under the least length are noise.
    """
    pairs = box_join(traces.select("source_row", "side", "sources", "traces", "min_x", "min_y", "max_x", "max_y"), polys.select("frequency_row", "polys", "min_x", "min_y", "max_x", "max_y"), CELL, tolerance)

    schema = pa.schema([("source_row", pa.int64()), ("side", pa.string()), ("frequency_row", pa.int64()), ("part", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("source_lo", pa.float64()), ("source_hi", pa.float64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, side, sources, traces_, freq, shape in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                polygons = [_plain(p) for p in shape]
                for part, (source, trace) in enumerate(zip(_plain(sources), _plain(traces_), strict=True)):
                    for lo, hi in K.overlap(trace, polygons, tolerance):
                        if hi - lo >= vocab.LEAST_OVERLAP_FEET and (mapped := K.to_source(source, trace, lo, hi)):
                            out.append((row, side, freq, part, float(lo), float(hi), *map(float, mapped)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return pairs.select(F.col("l_source_row").cast("long"), "l_side", "l_sources", "l_traces", F.col("r_frequency_row").cast("long"), "r_polys").mapInArrow(make, "source_row long, side string, frequency_row long, part int, lo double, hi double, source_lo double, source_hi double")


def pieces(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds geometry, the pieces of each row's sources at its intervals (array of part, lo, hi)."""
    fields = [f for f in df.schema if f.name in keys]
    names = [f.name for f in fields]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sources, spans in zip(batch["sources"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                lines = _plain(sources)
                found = [K.substring(lines[s["part"]], s["lo"], s["hi"]) for s in spans or []]
                out.append(_rows([list(x) for x in dict.fromkeys(tuple(map(tuple, line)) for line in found)]))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out, _LINES)], names=[*names, "geometry"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(*names, "sources", "spans").mapInArrow(make, f"{schema}, geometry {_LINES_SQL}")


@dataclass
class Overlay:
    sides: DataFrame  # two rows for each source row: outcome, reason, coverage
    candidates: DataFrame  # one row for each side and schedule signature
    features: DataFrame  # one row for each face, borough and signature
    unknown: DataFrame  # faces whose schedule isn't known, with the reason
    polygons: DataFrame  # schedule polygons with their outcome
    rows: DataFrame  # outcome of rows that ended early


def overlay(lion: DataFrame, freq: DataFrame, distance: float = vocab.OFFSET_FEET, tolerance: float = vocab.TOLERANCE_FEET) -> Overlay:
    """Runs the whole overlay; expensive steps are checkpointed, so a checkpoint folder must be set."""
    early, canonical = P.segments(lion)
    polys = P.polygons(freq).checkpoint()
    if P.missing_fields(lion, P.LINE_FIELDS):
        empty = early.select("source_row", F.explode(F.array(F.lit("LEFT"), F.lit("RIGHT"))).alias("side"), "outcome", "reason")
        none = polys.limit(0)
        return Overlay(empty, none, none, none, polys.withColumn("outcome", F.when(F.size("errors") > 0, "invalid").otherwise("unused_valid")), early)
    lost = [f for f in vocab.TYPE_FIELDS.values() if f not in freq.columns]
    rows = P.side_rows(canonical)
    if lost:
        rows = rows.withColumn("reason", F.when(F.col("outcome").isNull() | (F.col("outcome") != "non_addressable"), "polygons lack required fields").otherwise(F.col("reason"))).withColumn("outcome", F.coalesce(F.when(F.col("outcome") == "non_addressable", F.col("outcome")), F.lit("invalid")))
    rows = rows.checkpoint()
    key = ["source_row", "side"]
    # only sides that need geometry reach the kernels
    traced = offset_traces(rows.where("outcome is null"), key, distance).checkpoint()
    good = traced.where("error is null")
    usable = polys.where("min_x is not null")
    exact = overlaps(good, usable).checkpoint()
    rest = good.join(exact.select(*key).distinct(), key, "left_anti")
    near = overlaps(rest, usable, tolerance)
    told = polys.select(F.col("frequency_row").cast("long"), "signature", "object_id", "schedule_code", "section", "district", (F.size("errors") > 0).alias("broken"))
    found = exact.withColumn("used_tolerance", F.lit(False)).union(near.withColumn("used_tolerance", F.lit(True))).join(F.broadcast(told) if not R.over_cap(told, MOST_BROADCAST) else told, "frequency_row").checkpoint()
    covered = merged_intervals(found.select(*key, "part", "lo", "hi"), [*key, "part"]).groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    clash = conflicts(found, [*key, "part"]).select(*key).distinct().withColumn("clash", F.lit(True))
    met = found.groupBy(*key).agg(F.bool_or("broken").alias("meets_broken"), F.bool_or("used_tolerance").alias("used_tolerance"))
    facts = traced.select(*key, "trace_length", "used_offset", "strategy", "error").join(met, key, "left").join(covered, key, "left").join(clash, key, "left")
    facts = facts.withColumn("covered", F.least("covered", "trace_length"))
    gap = F.col("trace_length") - F.col("covered") > F.greatest(F.lit(0.01), F.col("trace_length") * 1e-6)
    outcome = (
        F.when(F.col("error").isNotNull(), "invalid").when(F.col("meets_broken").isNull(), "outside_schedule_area").when(F.col("meets_broken"), "invalid")
        .when(F.col("clash"), "ambiguous").when(gap, "partially_outside_schedule_area").otherwise("matched")
    )
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("meets_broken").isNull(), "the trace meets no polygon").when(F.col("meets_broken"), "the trace meets an invalid polygon")
        .when(F.col("clash"), "polygons of different schedules overlap on the trace").when(gap, "only part of the trace lies in polygons")
    )
    facts = facts.select(*key, "trace_length", "covered", "used_offset", "strategy", "used_tolerance", outcome.alias("o"), reason.alias("r"))
    sides = rows.join(facts, key, "left").withColumn("outcome", F.coalesce("outcome", "o")).withColumn("reason", F.coalesce("reason", "r")).drop("o", "r").withColumn("coverage_ratio", F.col("covered") / F.col("trace_length")).checkpoint()
    # candidates: a side's pieces by signature
    emitting = sides.where(F.col("outcome").isin("matched", "partially_outside_schedule_area")).select(*key, "block_face_id", "segment_id", "borough", "street", "street_names", "source_rows", "records")
    groups = found.join(emitting.select(*key), key, "left_semi").groupBy(*key, "signature").agg(F.array_sort(F.collect_set("object_id")).alias("object_ids"), F.array_sort(F.collect_set(F.struct("object_id", "frequency_row", "schedule_code", "section", "district"))).alias("freq_sources"), F.array_sort(F.collect_set(F.struct("part", F.col("source_lo").alias("lo"), F.col("source_hi").alias("hi")))).alias("spans"))
    drawn = pieces(groups.join(good.select(*key, "sources"), key), [*key, "signature"])
    candidates = groups.drop("spans").join(drawn, [*key, "signature"]).join(emitting, key).checkpoint()
    # features: candidates of one face, borough and signature; the first by segment, row and side sets the display side
    first = F.min(F.struct("segment_id", "source_row", "side", "street"))
    shown = candidates.groupBy("block_face_id", "borough", "signature").agg(first.alias("f")).select("block_face_id", "borough", "signature", "f.side", "f.segment_id", F.col("f.street").alias("street_name"))
    turned = candidates.select("block_face_id", "borough", "signature", F.col("side").alias("own"), "segment_id", "source_row", "source_rows", "street_names", "records", "object_ids", "freq_sources", "geometry").join(shown.withColumnRenamed("segment_id", "first_segment"), ["block_face_id", "borough", "signature"])
    turned = turned.withColumn("geometry", F.when(F.col("own") == F.col("side"), F.col("geometry")).otherwise(G.reverse_lines(F.col("geometry"))))
    merged = turned.groupBy("block_face_id", "borough", "signature", "side", F.col("first_segment").alias("segment_id"), "street_name").agg(
        G.combine(F.transform(F.array_sort(F.collect_list(F.struct(F.col("segment_id").alias("s"), "source_row", "own", "geometry"))), lambda x: x["geometry"])).alias("lines"),
        F.array_sort(F.collect_set("segment_id")).alias("segment_ids"), united("street_names").alias("street_names"),
        united("object_ids").alias("dsny_object_ids"), united("freq_sources").alias("dsny_sources"), united("source_rows").alias("source_rows"),
        F.array_sort(F.collect_set(F.struct(F.col("segment_id").alias("segment_id"), F.col("own").alias("source_side"), "source_rows", "street_names", F.col("records").alias("source_records"), F.col("object_ids").alias("dsny_object_ids")))).alias("lion_components"),
    )
    merged = split_marks(merged, "block_face_id", "borough")
    states = polys.where("size(errors) = 0").groupBy("signature").agg(*(F.any_value(f"state_{t}").alias(t) for t in vocab.TYPES))
    features = merged.join(states, "signature").withColumn("feature_key", F.when(F.col("n_parts") > 1, T.split_key(F.col("block_face_id"), F.col("borough"), F.col("signature"))).otherwise(F.col("block_face_id"))).drop("n_parts")
    # unknown faces: what has geometry but no schedule
    spans = found.groupBy(*key).agg(F.collect_list(F.struct("part", F.col("source_lo").alias("lo"), F.col("source_hi").alias("hi"))).alias("spans"))
    partial = sides.where("outcome = 'partially_outside_schedule_area'").select(*key).join(spans, key).join(good.select(*key, "sources"), key)
    holes = uncovered(partial, key)
    why = F.when(F.col("outcome") == "non_addressable", "MISSING_FACE_ID").when(F.col("outcome") == "outside_schedule_area", "OUTSIDE_SCHEDULE_AREA").otherwise("PARTIAL_COVERAGE")
    unknown = sides.where(F.col("outcome").isin("non_addressable", "outside_schedule_area", "partially_outside_schedule_area")).join(holes, key, "left")
    unknown = unknown.withColumn("lines", F.when(F.col("outcome") == "partially_outside_schedule_area", F.col("hole")).otherwise(F.col("lines"))).where(G.line_error(F.col("lines")).isNull())
    unknown = unknown.select(F.concat_ws(":", F.lit("unknown"), "segment_id", "source_row", "side").alias("unknown_id"), "technical_identity", "segment_id", "side", F.col("street").alias("street_name"), "borough", why.alias("reason_code"), "reason", "lines")
    used = found.select("frequency_row").distinct().withColumn("used", F.lit(True))
    outcomes = polys.withColumn("frequency_row", F.col("frequency_row").cast("long")).join(used, "frequency_row", "left").withColumn("outcome", F.when(F.size("errors") > 0, "invalid").when(F.col("used"), "used_valid").otherwise("unused_valid")).drop("used")
    both = early.select("source_row", F.explode(F.array(F.lit("LEFT"), F.lit("RIGHT"))).alias("side"), "outcome", "reason")
    return Overlay(sides.unionByName(both, allowMissingColumns=True), candidates, features, unknown, outcomes, early)


def conflicts(spans: DataFrame, keys: list[str], row: str = "frequency_row", sign: str = "signature", least: float = 1e-6) -> DataFrame:
    """Rows (keys, first, second) of pairs of spans (keys, row, sign, lo, hi) of different signs that share more than ``least``.

    The pairs meet by cells of the spans' own width, so many spans under one key aren't compared each with each.
    """
    width = spans.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 1.0
    narrow = spans.select(*keys, row, sign, "lo", "hi")
    pairs = interval_join(narrow, narrow, float(width) or 1.0, on=tuple(keys))
    share = F.least("l_hi", "r_hi") - F.greatest("l_lo", "r_lo")
    pairs = pairs.where((F.col(f"l_{row}") < F.col(f"r_{row}")) & (F.col(f"l_{sign}") != F.col(f"r_{sign}")) & (share > least))
    return pairs.select(*(F.col(f"l_{k}").alias(k) for k in keys), F.col(f"l_{row}").alias("first"), F.col(f"r_{row}").alias("second"))


def split_marks(df: DataFrame, origin: str, area: str) -> DataFrame:
    """Adds n_parts, is_split and is_area_split: how many rows an origin has, and whether they differ in area. Joined back by origin, pre-aggregated."""
    g = df.groupBy(origin).agg(F.count("*").alias("n_parts"), F.min(area).alias("_lo"), F.max(area).alias("_hi"))
    marks = g.select(origin, "n_parts", (F.col("n_parts") > 1).alias("is_split"), (F.col("_lo") != F.col("_hi")).alias("is_area_split"))
    return df.join(marks, origin)


def united(column: str) -> Column:
    """An aggregate: the distinct elements of all arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def uncovered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, hole): what the spans leave of the sources."""
    fields = [f for f in df.schema if f.name in keys]
    names = [f.name for f in fields]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sources, spans in zip(batch["sources"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                left = []
                for part, line in enumerate(_plain(sources)):
                    at, whole = 0.0, K.length(line)
                    for lo, hi in [*K.merge([(s["lo"], s["hi"]) for s in spans if s["part"] == part]), (whole, whole)]:
                        if lo - at > 1e-6:
                            left.append(K.substring(line, at, lo))
                        at = max(at, hi)
                out.append(_rows(left))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out, _LINES)], names=[*names, "hole"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(*names, "sources", "spans").mapInArrow(make, f"{schema}, hole {_LINES_SQL}")


def audit(lion: DataFrame, freq: DataFrame, o: Overlay) -> dict:
    """Counts of every outcome, the three reconciliations, fatal arithmetic and the verdict, from one pass over counts."""
    outcomes = {r[0]: r[1] for r in gates.outcome_counts(o.sides, "outcome", vocab.SIDE_OUTCOMES).collect()}
    shapes = {r[0]: r[1] for r in gates.outcome_counts(o.polygons, "outcome", vocab.POLYGON_OUTCOMES).collect()}
    rows, shapes_n = lion.count(), freq.count()
    if "is_split" in o.features.columns:
        features, split_faces, area_splits = o.features.agg(F.count("*"), F.count_distinct(F.when(F.col("is_split"), F.col("block_face_id"))), F.count_distinct(F.when(F.col("is_area_split"), F.col("block_face_id")))).first()
        multi = P.multi_geometry(lion).count()
    else:
        features = split_faces = area_splits = multi = 0
    errors = P.schema_errors(lion, freq)
    recon = {"sides": (2 * rows, sum(outcomes.values())), "source_rows": (rows, o.sides.select("source_row").distinct().count()), "polygons": (shapes_n, sum(shapes.values()))}
    fatal = sum(outcomes[k] for k in vocab.FATAL_OUTCOMES) + shapes["unused_valid"] + shapes["invalid"] + len(errors)
    reconciled = all(a == b for a, b in recon.values())
    return {"outcomes": outcomes, "frequency_outcomes": shapes, "output_features": features, "split_faces": split_faces, "borough_split_faces": area_splits, "multi_geometry_segments": multi, "global_errors": errors, "reconciliation": {k: {"expected": a, "classified": b, "difference": a - b, "passed": a == b} for k, (a, b) in recon.items()}, "fatal": fatal, "passed": reconciled and fatal == 0 and features > 0}
