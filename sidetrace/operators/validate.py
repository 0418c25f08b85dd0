"""Independent checks: processed features, tiles against the store, audits; each gives rows (rule, id) of what is wrong."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import geo as G
from sidetrace.operators import digest as D
from sidetrace.operators import release, sinks, store
from sidetrace.operators import tiles as T


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts)


def features(df: DataFrame) -> DataFrame:
    """Features (feature_key, block_face_id, street_name, borough, side, lines, dsny_object_ids, REFUSE...BULK) that break a rule."""
    known = F.array(*(F.lit(d) for d in vocab.DAYS))
    rules = {
        "blank_text": (F.coalesce(F.trim("feature_key"), F.lit("")) == "") | (F.coalesce(F.trim("street_name"), F.lit("")) == ""),
        "unknown_side": ~F.coalesce(F.col("side").isin("LEFT", "RIGHT"), F.lit(False)),
        "unknown_borough": ~F.coalesce(F.col("borough").isin(*vocab.BOROUGHS.values()), F.lit(False)),
        "bad_geometry": G.line_error(F.col("lines")).isNotNull(),
        "no_source": F.size("dsny_object_ids") < 1,
        "refuse_without_days": F.size("REFUSE.days") < 1,
        "unknown_weekday": reduce(lambda a, b: a | b, (F.size(F.array_except(F.col(t)["days"], known)) > 0 for t in vocab.TYPES)),
        "unknown_state": reduce(lambda a, b: a | b, (~F.col(t)["state"].isin(*vocab.STATES[:3]) for t in vocab.TYPES)),
        "days_without_state": reduce(lambda a, b: a | b, ((F.size(F.col(t)["days"]) > 0) == (F.col(t)["state"] == vocab.BLANK) for t in vocab.TYPES)),
        "derived_without_recycling": (F.col("ORGANICS.state") == vocab.DERIVED) & ((F.col("ORGANICS.days") != F.col("RECYCLING.days")) | (F.col("ORGANICS.rule_id") != vocab.ORGANICS_RULE)),
    }
    broken = df.select(F.col("feature_key").alias("id"), F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())).alias("rule")).select("rule", "id")
    repeated = df.groupBy("feature_key").count().where("count > 1").select(F.lit("repeated_key"), "feature_key")
    return broken.union(repeated)


def tiles(encoded: DataFrame, faces_wide: DataFrame, zooms: tuple[int, ...]) -> DataFrame:
    """Decodes every tile: a feature once a tile, the same properties everywhere, all known features at the largest zoom, none else."""
    seen = T.decode_tiles(encoded)
    ids = faces_wide.select("feature_id")
    prints = seen.select("feature_id", D.canonical(F.array_sort(F.map_entries("props")).alias("p")).alias("p"))
    at_max = seen.where(F.col("z") == max(zooms)).select("feature_id").distinct()
    return _union([
        seen.groupBy("z", "x", "y", "layer", "feature_id").count().where("count > 1").select(F.lit("repeated_in_tile").alias("rule"), F.col("feature_id").alias("id")),
        prints.groupBy("feature_id").agg(F.size(F.collect_set("p")).alias("n")).where("n > 1").select(F.lit("properties_differ"), "feature_id"),
        ids.join(at_max, "feature_id", "left_anti").select(F.lit("lost_at_largest_zoom"), "feature_id"),
        seen.where("layer <> 'unknown'").select("feature_id").distinct().join(ids, "feature_id", "left_anti").select(F.lit("ghost"), "feature_id"),
        seen.where(~F.col("z").isin(*zooms)).select(F.lit("zoom_out_of_range"), F.col("z").cast("string")).distinct(),
    ])


#: What a tile's feature says, by layer; the id stands beside. Fixed values.
LAYER_KEYS = {"faces": ("street_name", "borough", "side", *(f"{t.lower()}_{k}" for k in ("days", "state") for t in vocab.TYPES)), "unknown": ("street_name", "borough", "side", "reason_code", "reason")}


def tile_layers(encoded: DataFrame, layers: DataFrame, zooms: tuple[int, ...]) -> DataFrame:
    """Decodes every tile against the features (feature_id, layer, props) it should hold: layers, their zooms, keys and values, and the unknown ones too."""
    seen = T.decode_tiles(encoded).select("z", "layer", "feature_id", "props")
    keys = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in LAYER_KEYS.items() for x in (F.lit(k), F.array(*(F.lit(c) for c in sorted(v)))))), F.col("layer")), F.array().cast("array<string>"))
    wanted = layers.select("layer", "feature_id", D.canonical(F.array_sort(F.map_entries("props")).alias("p")).alias("want"))
    got = seen.select("layer", "feature_id", D.canonical(F.array_sort(F.map_entries("props")).alias("p")).alias("got")).distinct()
    unknown = layers.where("layer = 'unknown'").select("feature_id")
    low = seen.where((F.col("layer") == "unknown") & (F.col("z") < vocab.UNKNOWN_ZOOM))
    parts = [
        seen.where(~F.col("layer").isin(*LAYER_KEYS)).select(F.lit("unknown_layer").alias("rule"), F.col("feature_id").alias("id")),
        seen.where(F.array_sort(F.map_keys("props")) != keys).select(F.lit("layer_schema"), "feature_id"),
        got.join(wanted, ["layer", "feature_id"], "left").where(~F.col("got").eqNullSafe(F.col("want"))).select(F.lit("value_differs"), "feature_id"),
        low.select(F.lit("unknown_below_its_zoom"), "feature_id"),
    ]
    if max(zooms) >= vocab.UNKNOWN_ZOOM:
        at_max = seen.where((F.col("z") == max(zooms)) & (F.col("layer") == "unknown")).select("feature_id").distinct()
        parts.append(unknown.join(at_max, "feature_id", "left_anti").select(F.lit("unknown_lost_at_largest_zoom"), "feature_id"))
    return _union([p.distinct() for p in parts])


#: The tables of a whole release. Fixed values.
BUNDLE = ("block_faces", "collection_schedules", "block_face_collection_states", "block_face_dsny_sources", "block_face_lion_components", "unknown_block_faces", "unknown_wide", "faces_wide", "tiles", "tile_metadata", "audit", "audit_records")


def bundle(spark: SparkSession, root: str) -> list[str]:
    """What is wrong with the current release as a whole: its tables, their files and row counts, its audit, metadata and counts, each told from the files alone."""
    m = release.read(root)
    wrong = [f"table {t} is missing" for t in BUNDLE if t not in m["artifacts"]] + [f"table {t} is unexpected" for t in m["artifacts"] if t not in BUNDLE]
    if wrong:
        return wrong
    for name, a in m["artifacts"].items():
        if release.folder_digest(f"{root.rstrip('/')}/{a['path']}") != a["sha256"]:
            wrong.append(f"{name} doesn't match its digest")
    if wrong:
        return wrong
    t = release.load(spark, root, check=False)
    wrong += [f"{name} has another number of rows" for name, a in m["artifacts"].items() if t[name].count() != a["rows"]]
    row = t["audit"].first()
    doc = json.loads(row["audit"])
    wrong += [f"audit: {x}" for x in audit(doc)]
    if release.rows_digest({k: t[k] for k in BUNDLE[:6]}) != row["source_sha256"]:
        wrong.append("the audit is of other tables")
    try:
        meta = sinks.read_metadata(t["tile_metadata"])
    except sinks.MetadataError as e:
        return [*wrong, f"metadata: {e}"]
    again = sinks.read_metadata(sinks.archive_metadata(t["tiles"], t["block_faces"], m["version"], tuple(range(meta["minzoom"], meta["maxzoom"] + 1))))
    same = ("version", "minzoom", "maxzoom", "bounds", "feature_count", "tile_count", "tile_bytes", "tile_bytes_max", "tile_bytes_p95", "raw_bytes", "zoom_metrics", "json")
    wrong += [f"metadata: {k} isn't what the tiles say" for k in same if meta[k] != again[k]]
    from sidetrace.operators import refresh

    found = refresh.counts(doc, t, T.decode_tiles(t["tiles"]))
    wrong += [f"count {k} is {found.get(k)}, not {n}" for k, n in m["counts"].items() if found.get(k) != n]
    return wrong + [f"{r['rule']}: {r['id']}" for r in store.violations(t).union(store.load_errors(t)).limit(10).collect()]


def same_tables(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (rule, id) where two tables, rebuilt independently, differ in the digests of their records."""
    one, two = (df.select(F.col(key).cast("string").alias("id"), D.record_digest(*sorted(columns)).alias("digest")) for df in (expected, actual))
    return D.diff(one, two).select(F.col("verdict").alias("rule"), "id")


def audit(doc: dict) -> list[str]:
    """What is inconsistent in an audit document."""
    wrong = [f"{k} isn't reconciled" for k, r in doc["reconciliation"].items() if r["difference"] != r["expected"] - r["classified"] or r["passed"] != (r["difference"] == 0)]
    if set(doc["outcomes"]) != set(vocab.SIDE_OUTCOMES) or set(doc["frequency_outcomes"]) != set(vocab.POLYGON_OUTCOMES):
        wrong.append("outcome names")
    fatal = sum(doc["outcomes"].get(k, 0) for k in vocab.FATAL_OUTCOMES) + doc["frequency_outcomes"].get("unused_valid", 0) + doc["frequency_outcomes"].get("invalid", 0) + len(doc["global_errors"])
    if fatal != doc["fatal"]:
        wrong.append("fatal count")
    if sum(doc["outcomes"].values()) != doc["reconciliation"]["sides"]["classified"]:
        wrong.append("side total")
    if doc["passed"] != (fatal == 0 and doc["output_features"] > 0 and all(r["passed"] for r in doc["reconciliation"].values())):
        wrong.append("verdict")
    return wrong
