"""A whole refresh: overlay, audit, store, tiles of both layers, validation, regression and policy gates, publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.operators import gates, release, sides, sinks, store, tiles, validate

#: Counts that the regression gate compares, beside schedule rows by type. Fixed values.
GATED = ("raw_lion_rows", "dsny_frequency_rows", "matched_sides", "output_features", "schedule_rows", "tile_features")


def tile_layers(t: dict[str, DataFrame]) -> DataFrame:
    """Features (feature_id, layer, lines, props) of both layers: known faces, and unknown ones, which appear at the larger zooms."""

    def layer(df: DataFrame, name: str) -> DataFrame:
        props = [c for c in df.columns if c not in ("feature_id", "lines")]
        return df.select("feature_id", F.lit(name).alias("layer"), "lines", F.create_map(*(x for c in props for x in (F.lit(c), F.coalesce(F.col(c), F.lit(""))))).alias("props"))

    return layer(t["faces_wide"], "faces").union(layer(t["unknown_wide"], "unknown"))


def counts(audit: dict, t: dict[str, DataFrame], seen: DataFrame) -> dict[str, int]:
    """The counts of a release: rows of the sources, sides, tables, tiles, and schedule rows by type."""
    schedules = t["collection_schedules"]
    by_type = {r["collection_type"]: r["n"] for r in schedules.groupBy("collection_type").agg(F.count("*").alias("n")).collect()}
    known, unknown = seen.agg(F.count_distinct(F.when(F.col("layer") == "faces", F.col("feature_id"))), F.count_distinct(F.when(F.col("layer") == "unknown", F.col("feature_id")))).first()
    out = audit["outcomes"]
    return {
        "raw_lion_rows": audit["reconciliation"]["source_rows"]["expected"], "dsny_frequency_rows": audit["reconciliation"]["polygons"]["expected"],
        "eligible_lion_sides": sum(n for k, n in out.items() if k not in ("out_of_scope", "deduplicated_alias")), "matched_sides": out["matched"], "used_frequency_rows": audit["frequency_outcomes"]["used_valid"],
        "output_features": audit["output_features"], "block_faces": t["block_faces"].count(), "schedule_rows": sum(by_type.values()), "schedule_groups": store.day_lists(schedules).count(),
        "tile_features": known, "unknown_features": unknown, **{f"schedule_rows_{k}": by_type.get(k, 0) for k in vocab.TYPES},
    }


def regression(spark: SparkSession, previous: dict[str, int], current: dict[str, int], floors: dict[str, int] | None = None, max_drop: float = vocab.MAX_DROP) -> DataFrame:
    """The gate over the six counts and the schedule rows of the four types; a first release has its floors alone to reach."""
    names = [*GATED, *(f"schedule_rows_{t}" for t in vocab.TYPES)]
    frame = lambda d: spark.createDataFrame([(k, d[k]) for k in names if k in d], "metric string, n long")
    return gates.regression(frame(previous), frame(current), vocab.FLOORS if floors is None else {"": 0, **floors}, max_drop)


def problems(o: sides.Overlay, t: dict[str, DataFrame], built: DataFrame, layers: DataFrame, zooms: tuple[int, ...]) -> DataFrame:
    """Rows (rule, id) of all that is wrong with features, store, loads and tiles."""
    wide = store.load_wide(t)
    same = [c for c in wide.columns if c not in ("lines",)]
    parts = [
        validate.features(o.features), store.violations(t), store.load_errors(t), validate.same_tables(t["faces_wide"].select(*same), wide.select(*same), "feature_id", same),
        validate.tiles(built, t["faces_wide"], zooms), validate.tile_layers(built, layers, zooms), gates.size_gate(built).select(F.lit("tile_too_large").alias("rule"), F.concat_ws("/", "z", "x", "y").alias("id")),
    ]
    return reduce(lambda a, b: a.union(b), parts)


def run(spark: SparkSession, lion: DataFrame, freq: DataFrame, root: str, version: str | None, retrieved_at: str, source: str, floors: dict[str, int] | None = None, as_of: str | None = None, zooms: tuple[int, ...] | None = None, keep: int = 3) -> dict:
    """Publishes a release of the sources, or raises ReleaseError with what stands against it and leaves the current one.

    Needs a checkpoint folder. Without a version one is made of the time and the digest of the tables' rows. as_of is the
    day for the policy's age; a policy past its limit blocks, as do a broken audit, any problem, and the regression gate.
    """
    zooms = zooms or tuple(range(vocab.MIN_ZOOM, vocab.MAX_ZOOM + 1))
    o = sides.overlay(lion, freq)
    audit = sides.audit(lion, freq, o)
    if not audit["passed"] or validate.audit(audit):
        raise release.ReleaseError(f"the audit failed: {validate.audit(audit) or audit['global_errors'] or [k for k, n in audit['outcomes'].items() if n and k in vocab.FATAL_OUTCOMES] or audit['frequency_outcomes']}")
    if as_of is not None and (age := spark.range(1).select(gates.policy_age(F.lit(as_of).cast("date"))).first()[0]) == "block":
        raise release.ReleaseError(f"the organics policy was reviewed too long ago ({age})")
    t = {k: df.checkpoint() for k, df in store.tables(o.features, o.unknown, source, retrieved_at).items()}
    layers = tile_layers(t)
    built = tiles.build_tiles(layers, zooms).checkpoint()
    if wrong := problems(o, t, built, layers, zooms).limit(10).collect():
        raise release.ReleaseError(f"the release is unsound: {[tuple(r) for r in wrong]}")
    now = counts(audit, t, tiles.decode_tiles(built))
    before = release.read(root, missing_ok=True)
    gate = regression(spark, before["counts"] if before else {}, now, floors)
    digest = release.rows_digest({k: df for k, df in t.items() if k not in ("faces_wide", "unknown_wide")})
    version = version or release.version(digest)
    metadata = sinks.archive_metadata(built, t["block_faces"], version, zooms, source_sha256=digest, unknown_feature_count=now["unknown_features"], data_updated=sinks.data_updated(t["collection_schedules"]))
    audit_row = spark.createDataFrame([(release.canonical_json(audit), digest)], "audit string, source_sha256 string")
    return release.publish(root, version, {**t, "tiles": built, "tile_metadata": metadata, "audit": audit_row, "audit_records": sinks.audit_records(o.sides)}, gate, keep, now, {"tiles": "z"})
