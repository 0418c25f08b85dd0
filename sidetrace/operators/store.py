"""Relational tables of a release, from features and unknown faces, and their integrity checks as violation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import geo as G
from sidetrace.functions import text as T
from sidetrace.operators import relate as R


def tables(features: DataFrame, unknown: DataFrame, source: str, retrieved_at: str) -> dict[str, DataFrame]:
    """block_faces, collection_schedules, block_face_collection_states, the lineage tables block_face_dsny_sources and block_face_lion_components, unknown_block_faces, and the wide forms that tiles are made of."""
    lonlat = G.project(F.col("lines"), lambda x, y: G.plane_to_lonlat(x, y))
    f = features.withColumn("lines", lonlat).withColumn("_b", G.bounds(F.col("lines")))
    faces = f.select(F.col("feature_key").alias("block_face_id"), F.col("block_face_id").alias("origin_block_face_id"), F.array_join("segment_ids", "|").alias("segment_id"), "borough", "street_name", "side", T.to_wkt(F.col("lines")).alias("geometry_wkt"), "_b.*")
    each = F.array(*(F.struct(F.lit(t).alias("collection_type"), F.col(t)["days"].alias("days"), F.col(t)["state"].alias("state"), F.col(t)["rule_id"].alias("rule_id"), F.col(t)["source_policy_conflict"].alias("source_policy_conflict")) for t in vocab.TYPES))
    states = f.select(F.col("feature_key").alias("block_face_id"), F.explode(each).alias("s")).select("block_face_id", "s.*")
    u = unknown.withColumn("lines", lonlat).withColumn("_b", G.bounds(F.col("lines")))
    day_lists = [F.array_join(F.col(t)["days"], ",").alias(f"{t.lower()}_days") for t in vocab.TYPES] + [F.col(t)["state"].alias(f"{t.lower()}_state") for t in vocab.TYPES]
    return {
        "block_faces": faces,
        "collection_schedules": states.select("block_face_id", "collection_type", F.explode("days").alias("weekday"), F.lit(source).alias("source"), F.lit(retrieved_at).alias("retrieved_at")),
        "block_face_collection_states": states.select("block_face_id", "collection_type", F.to_json("days").alias("effective_days_json"), "state", F.concat(F.lit("FREQ_"), "collection_type").alias("source_field"), "rule_id", "source_policy_conflict"),
        "block_face_dsny_sources": f.select(F.col("feature_key").alias("block_face_id"), F.explode("dsny_sources").alias("s")).select("block_face_id", F.col("s.object_id").alias("dsny_object_id"), "s.frequency_row", "s.schedule_code", "s.section", "s.district"),
        "block_face_lion_components": R.indexed(f.select(F.col("feature_key").alias("block_face_id"), F.explode("lion_components").alias("c")).select("block_face_id", "c.segment_id", "c.source_side", F.to_json("c.source_rows").alias("source_rows_json"), F.to_json("c.street_names").alias("street_names_json"), F.to_json("c.source_records").alias("source_records_json"), F.to_json("c.dsny_object_ids").alias("dsny_object_ids_json")), "block_face_id", ["segment_id", "source_side", "source_rows_json"]),
        "unknown_block_faces": u.select("unknown_id", "technical_identity", "segment_id", "side", "street_name", "borough", "reason_code", "reason", T.to_wkt(F.col("lines")).alias("geometry_wkt"), "_b.*"),
        "unknown_wide": u.select(F.col("unknown_id").alias("feature_id"), "street_name", "borough", "side", "lines", "reason_code", "reason"),
        "faces_wide": f.select(F.col("feature_key").alias("feature_id"), "street_name", "borough", "side", "lines", *day_lists),
    }


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """Rows (rule, id) of everything that breaks the store's constraints; a sound store has none."""
    faces, schedules, states, unknown = t["block_faces"], t["collection_schedules"], t["block_face_collection_states"], t["unknown_block_faces"]
    key = "block_face_id"
    per_face = R.distinct_counts(states, key, "collection_type")
    sides_ok = faces.where(~F.col("side").isin("LEFT", "RIGHT") | F.col("side").isNull())
    boxes = faces.where("min_x is null or min_x > max_x or min_y > max_y")
    refuse = states.where((F.col("collection_type") == "REFUSE") & (F.col("effective_days_json") == "[]"))
    rules = {
        "repeated_face": R.repeated(faces, key),
        "schedule_without_face": R.orphans(schedules, key, faces),
        "state_without_face": R.orphans(states, key, faces),
        "face_without_states": R.orphans(faces, key, states),
        "not_four_states": R.wrong_counts(states, key, len(vocab.TYPES)).select(key).union(per_face.where(f"n <> {len(vocab.TYPES)}").select(key)).distinct(),
        "unknown_state": states.where(~F.col("state").isin(*vocab.STATES[:3])),
        "unknown_weekday": schedules.where(~F.col("weekday").isin(*vocab.DAYS)),
        "repeated_schedule": R.repeated(schedules, key, "collection_type", "weekday"),
        "refuse_without_days": refuse,
        "derived_elsewhere": states.where((F.col("state") == vocab.DERIVED) & ((F.col("collection_type") != "ORGANICS") | F.col("rule_id").isNull())),
        "bad_side": sides_ok,
        "bad_bounds": boxes,
        "unknown_with_schedule": unknown.select(F.col("technical_identity").alias(key)).join(schedules, key, "left_semi"),
    }
    out = None
    for rule, df in rules.items():
        part = df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))
        out = part if out is None else out.union(part)
    return out.union(R.repeated(unknown, "unknown_id").select(F.lit("repeated_unknown"), "unknown_id"))


def merge_repeated(df: DataFrame, key: str, same: list[str], merge: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row a key with the arrays of ``merge`` united and sorted, keys whose ``same`` columns disagree)."""
    g = df.groupBy(key).agg(F.min(F.struct(*same)).alias("_low"), F.max(F.struct(*same)).alias("_high"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in merge))
    return g.where("_low <=> _high").select(key, "_low.*", *merge), g.where("not _low <=> _high").select(key)


def day_lists(schedules: DataFrame) -> DataFrame:
    """Rows (block_face_id, collection_type, weekdays): all days of a face and type, alphabetically."""
    return schedules.groupBy("block_face_id", "collection_type").agg(R.sorted_list("weekday").alias("weekdays"))


def schedule_columns(schedules: DataFrame) -> DataFrame:
    """One row a face: its days by type in calendar order ({type}_days), and whether all its rows name one source and time."""
    order = F.array(*(F.lit(d) for d in vocab.DAYS))
    days = lambda t: F.collect_set(F.when(F.col("collection_type") == t, F.col("weekday")))
    g = schedules.groupBy("block_face_id").agg(*(days(t).alias(t) for t in vocab.TYPES), F.min("source").alias("s0"), F.max("source").alias("s1"), F.min("retrieved_at").alias("t0"), F.max("retrieved_at").alias("t1"))
    lists = [F.array_join(F.array_intersect(order, F.col(t)), ",").alias(f"{t.lower()}_days") for t in vocab.TYPES]
    return g.select("block_face_id", *lists, F.col("s0").alias("source"), F.col("t0").alias("retrieved_at"), (F.col("s0").eqNullSafe(F.col("s1")) & F.col("t0").eqNullSafe(F.col("t1"))).alias("single_source"))


def load_wide(t: dict[str, DataFrame]) -> DataFrame:
    """faces_wide rebuilt from the stored tables alone, as tiles are built from a store that something else wrote.

    Days come from the schedule rows, states from the state rows, lines from the stored text. A face whose two tables say
    different days, that lacks a table or whose rows name several sources is an error (see load_errors).
    """
    states = t["block_face_collection_states"]
    wide = states.groupBy("block_face_id").agg(*(F.max(F.when(F.col("collection_type") == k, F.col("state"))).alias(f"{k.lower()}_state") for k in vocab.TYPES))
    lists = schedule_columns(t["collection_schedules"])
    faces = t["block_faces"].select("block_face_id", "street_name", "borough", "side", T.parse_wkt(F.col("geometry_wkt")).alias("lines"))
    days = [F.coalesce(f"{k.lower()}_days", F.lit("")).alias(f"{k.lower()}_days") for k in vocab.TYPES]
    return faces.join(wide, "block_face_id").join(lists, "block_face_id", "left").select(F.col("block_face_id").alias("feature_id"), "street_name", "borough", "side", "lines", *days, *(f"{k.lower()}_state" for k in vocab.TYPES))


def load_errors(t: dict[str, DataFrame]) -> DataFrame:
    """Rows (rule, id) of faces that can't be loaded for tiles: a table lacks them, their tables disagree, or their lines are broken."""
    key = "block_face_id"
    faces, schedules, states = t["block_faces"], t["collection_schedules"], t["block_face_collection_states"]
    lost = R.chain(faces, key, {"states": states, "sources": t["block_face_dsny_sources"], "components": t["block_face_lion_components"]})
    told = states.select(key, "collection_type", F.from_json("effective_days_json", "array<string>").alias("effective"))
    both = told.join(day_lists(schedules), [key, "collection_type"], "full_outer")
    other = both.where(~F.array_sort(F.coalesce("effective", F.array().cast("array<string>"))).eqNullSafe(F.coalesce("weekdays", F.array().cast("array<string>"))))
    broken = faces.where(G.line_error(T.parse_wkt(F.col("geometry_wkt"))).isNotNull())
    gaps = t["block_face_lion_components"].groupBy(key).agg(F.count("*").alias("n"), F.min("component_index").alias("lo"), F.max("component_index").alias("hi"), F.count_distinct("component_index").alias("d")).where("lo <> 0 or hi <> n - 1 or d <> n")
    parts = [
        lost.select(F.concat(F.lit("no_"), "missing").alias("rule"), F.col(key).alias("id")), other.select(F.lit("days_differ"), key).distinct(), broken.select(F.lit("broken_line"), key),
        schedule_columns(schedules).where("not single_source").select(F.lit("several_sources"), key), gaps.select(F.lit("component_gap"), key),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
