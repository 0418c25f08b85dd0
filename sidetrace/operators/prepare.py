"""Source rows to canonical line segments and schedule polygons; every row keeps an outcome.

Lines: source_row, SegmentID, SegmentTyp, FeatureTyp, Status, NonPed, L/RBlockFaceID, L/RBoro, Street, address fields, lines
(array of arrays of x, y in feet). Polygons: frequency_row, OBJECTID, FREQ_*, polys (polygon, ring, point).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import geo as G
from sidetrace.functions import text as T
from sidetrace.operators import relate as R

# Field names of the line source.
LINE_FIELDS = ("SegmentTyp", "FeatureTyp", "Status", "NonPed", "SegmentID", "LBlockFaceID", "RBlockFaceID", "LBoro", "RBoro", "Street", "FromLeft", "ToLeft", "FromRight", "ToRight")
OPTIONAL_FIELDS = ("SAFStreetName", "SpecAddr", "LocStatus", "BoroBndry", "PhysicalID", "GenericID", "LLo_Hyphen", "LHi_Hyphen", "RLo_Hyphen", "RHi_Hyphen")
ADDRESSES = {"LEFT": ("FromLeft", "ToLeft", "LLo_Hyphen", "LHi_Hyphen"), "RIGHT": ("FromRight", "ToRight", "RLo_Hyphen", "RHi_Hyphen")}
SIDES = {"LEFT": "L", "RIGHT": "R"}


def missing_fields(df: DataFrame, fields: tuple[str, ...]) -> list[str]:
    return [f for f in fields if f not in df.columns]


def with_optional(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.lit(None).cast("string").alias(f) for f in OPTIONAL_FIELDS if f not in df.columns))


def row_outcomes(lion: DataFrame) -> DataFrame:
    """Adds outcome and reason of rows that end before their sides are looked at, and segment_id and geometry_key; null outcomes go on."""
    lost = missing_fields(lion, LINE_FIELDS)
    if lost:
        return lion.select("*", F.lit("invalid").alias("outcome"), F.lit("missing fields: " + ", ".join(lost)).alias("reason"), F.lit(None).cast("string").alias("segment_id"), F.lit(None).cast("string").alias("geometry_key"))
    df = with_optional(lion)
    kind, feature, status = T.source_code(F.col("SegmentTyp")), T.source_code(F.col("FeatureTyp")), T.source_code(F.col("Status"))
    segment = T.clean_identifier(F.col("SegmentID"))
    scope = ~kind.isin(*vocab.SEGMENT_TYPES) | ~feature.isin(*vocab.FEATURE_TYPES)
    kerb = F.when(status != "2", "status is not constructed").when(T.source_code(F.col("NonPed")) == "V", "vehicles only")
    outcome = F.when(scope | kerb.isNotNull(), "out_of_scope").when(segment == "", "invalid")
    reason = F.when(scope, "segment or feature type out of scope").when(kerb.isNotNull(), kerb).when(segment == "", "missing segment ID")
    return df.select("*", outcome.alias("outcome"), reason.alias("reason"), segment.alias("segment_id"), G.geometry_key(F.col("lines"), F.col("source_row")).alias("geometry_key"))


def segments(lion: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that ended early: source_row, outcome, reason), (one canonical row of each alias group with what its aliases say).

    Rows of one segment and geometry are aliases. If they disagree on the face ids or on a side's borough, all are invalid;
    else the row without SpecAddr of smallest street and position stands for them, and the others are deduplicated.
    """
    rows = row_outcomes(lion)
    early = rows.where("outcome is not null").select("source_row", "outcome", "reason")
    if missing_fields(lion, LINE_FIELDS):
        return early, rows.limit(0)
    live = rows.where("outcome is null").drop("outcome", "reason")
    ids = {s: T.clean_identifier(F.col(f"{p}BlockFaceID")) for s, p in SIDES.items()}
    boro = {s: T.borough_name(F.col(f"{p}Boro")) for s, p in SIDES.items()}
    blank = {s: F.coalesce(F.trim(F.col(f"{p}Boro").cast("string")), F.lit("")).isin("", "0") for s, p in SIDES.items()}
    boundary = {s: (T.source_code(F.col("SegmentTyp")) == "U") & boro["RIGHT" if s == "LEFT" else "LEFT"].isNotNull() & (T.source_code(F.col("LocStatus")).isin("3", "4", "9") | ~T.is_non_addressable(F.col("BoroBndry"))) for s in SIDES}
    street = T.clean_text(T.first_present(F.col("Street"), F.col("SAFStreetName")))
    live = live.select(
        "*", street.alias("named_street"), (F.coalesce(F.trim("SpecAddr"), F.lit("")) != "").alias("special"),
        *(ids[s].alias(f"id_{s}") for s in SIDES), *(boro[s].alias(f"boro_{s}") for s in SIDES), *((boro[s].isNull() & ~blank[s]).alias(f"bad_boro_{s}") for s in SIDES),
        *(boundary[s].alias(f"boundary_{s}") for s in SIDES), *(T.usable_range(*(F.col(c) for c in ADDRESSES[s])).alias(f"range_{s}") for s in SIDES),
    )
    group = ["segment_id", "geometry_key"]
    told = live.groupBy(*group).agg(
        F.size(F.collect_set(F.struct("id_LEFT", "id_RIGHT"))).alias("n_ids"),
        *(F.size(F.collect_set(f"boro_{s}")).alias(f"n_boro_{s}") for s in SIDES), *(F.max(f"boro_{s}").alias(f"borough_{s}") for s in SIDES),
        *(F.bool_or(f"bad_boro_{s}").alias(f"any_bad_{s}") for s in SIDES), *(F.bool_and(f"boundary_{s}").alias(f"all_boundary_{s}") for s in SIDES), *(F.bool_or(f"range_{s}").alias(f"any_range_{s}") for s in SIDES),
        *(F.array_sort(F.collect_set(F.struct("source_row", F.col("named_street").alias("street"), *(F.col(c).cast("string").alias(n) for n, c in zip(("from_address", "to_address"), ADDRESSES[s][:2], strict=True))))).alias(f"records_{s}") for s in SIDES),
        F.array_sort(F.collect_set("source_row")).alias("source_rows"), F.array_sort(F.array_remove(F.collect_set("named_street"), "")).alias("street_names"),
        F.min(F.struct("special", "named_street", "source_row")).alias("first"),
    )
    conflict = F.when(F.col("n_ids") > 1, "aliases disagree on block-face ids").when(reduce(lambda a, b: a | b, ((F.col(f"n_boro_{s}") > 1) | F.col(f"any_bad_{s}") for s in SIDES)), "aliases disagree on boroughs")
    told = told.withColumn("conflict", conflict)
    # row-level verdicts join back on the group: geometry keys are digests, so the rows are narrow
    verdict = live.select("source_row", *group).join(told.select(*group, "conflict", F.col("first.source_row").alias("canonical")), group)
    ended = verdict.where(F.col("conflict").isNotNull() | (F.col("source_row") != F.col("canonical"))).select("source_row", F.when(F.col("conflict").isNotNull(), "invalid").otherwise("deduplicated_alias").alias("outcome"), F.coalesce("conflict", F.lit("exact alias of another row")).alias("reason"))
    keep = told.where("conflict is null").select(F.col("first.source_row").alias("source_row"), "source_rows", "street_names", *(F.col(f"borough_{s}") for s in SIDES), *(F.col(f"{c}_{s}") for c in ("all_boundary", "any_range", "records") for s in SIDES))
    canonical = live.select("source_row", "segment_id", F.col("named_street").alias("street"), "lines", F.col("PhysicalID").cast("string").alias("physical_id"), *(f"id_{s}" for s in SIDES)).join(keep, "source_row")
    return early.union(ended), canonical


def multi_geometry(lion: DataFrame) -> DataFrame:
    """Rows (segment_id, n_geometries, source_rows) of segments in scope that several geometries share."""
    rows = row_outcomes(lion).where("outcome is null")
    return rows.groupBy("segment_id").agg(F.count_distinct("geometry_key").alias("n_geometries"), F.array_sort(F.collect_set("source_row")).alias("source_rows")).where("n_geometries > 1")


def side_rows(canonical: DataFrame) -> DataFrame:
    """Two rows for each canonical segment, with the outcome of those that need no geometry; null outcomes go on."""
    each = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"id_{s}").alias("block_face_id"), F.col(f"borough_{s}").alias("borough"), F.col(f"all_boundary_{s}").alias("boundary"), F.col(f"any_range_{s}").alias("has_range"), F.col(f"records_{s}").alias("records")) for s in SIDES))
    df = canonical.select("source_row", "source_rows", "segment_id", "street_names", F.coalesce(F.nullif("street", F.lit("")), F.element_at(F.when(F.size("street_names") > 0, F.col("street_names")), 1), F.lit("")).alias("street"), "physical_id", "lines", F.explode(each).alias("s")).select("*", "s.*").drop("s")
    broken = G.line_error(F.col("lines"))
    nobody = T.is_non_addressable(F.col("block_face_id"))
    outcome = F.when(nobody, "non_addressable").when(broken.isNotNull() | (F.col("street") == ""), "invalid").when(F.col("borough").isNull(), F.when(F.col("boundary"), "out_of_scope").otherwise("invalid"))
    reason = (
        F.when(nobody & F.col("has_range"), "block-face id is missing; address ranges alone don't make a face").when(nobody, "no block-face id and no usable address range")
        .when(broken.isNotNull(), broken).when(F.col("street") == "", "missing street name")
        .when(F.col("borough").isNull(), F.when(F.col("boundary"), "borough is absent on an outside side").otherwise("missing or invalid borough"))
    )
    return df.select("*", F.concat(F.lit("LION:"), "segment_id", F.lit(":"), "side").alias("technical_identity"), outcome.alias("outcome"), reason.alias("reason"))


def polygons(freq: DataFrame) -> DataFrame:
    """Schedule polygons with states by type, signature, bounds and errors (array, empty if valid).

    The id is required and, if repeated, every row of it is invalid; REFUSE days are mandatory; a text that is no
    schedule is an error, a blank one of another type is an unknown state.
    """
    id_field = next((c for c in ("OBJECTID", "ObjectID", "objectid") if c in freq.columns), next((c for c in freq.columns if c.lower() == "objectid"), None))
    raw = {t: F.col(f) if f in freq.columns else F.lit(None).cast("string") for t, f in vocab.TYPE_FIELDS.items()}
    points = F.flatten(F.flatten("polys"))
    sound = F.col("polys").isNotNull() & (F.size("polys") > 0) & F.forall(F.flatten("polys"), lambda ring: F.size(ring) >= 3)
    df = freq.select("*", (T.clean_identifier(F.col(id_field)) if id_field else F.lit("")).alias("object_id"), *(T.schedule_state(t, raw[t], raw["RECYCLING"] if t == "ORGANICS" else None).alias(f"state_{t}") for t in vocab.TYPES), F.coalesce(sound, F.lit(False)).alias("sound"))
    repeats = R.repeated(df.where("object_id <> ''"), "object_id").withColumnRenamed("n", "n_same")
    df = df.join(repeats, "object_id", "left")
    errors = F.filter(
        F.array(
            F.when(F.col("object_id") == "", "missing source id"), F.when(F.col("n_same") > 1, "repeated source id"), F.when(~F.col("sound"), "polygon is missing or broken"),
            *(F.when(F.col(f"state_{t}")["error"].isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f"state_{t}")["error"])) for t, f in vocab.TYPE_FIELDS.items()),
        ), lambda e: e.isNotNull(),
    )
    edge = lambda f, c: F.when(F.col("sound"), f(F.transform(points, lambda p: p[c])))
    return df.select(
        "frequency_row", "object_id", *(column_or_null(freq, c).cast("string").alias(n) for c, n in (("SCHEDULECODE", "schedule_code"), ("SECTION", "section"), ("DISTRICT", "district"))), "polys", *(f"state_{t}" for t in vocab.TYPES), errors.alias("errors"), T.signature({t: F.col(f"state_{t}") for t in vocab.TYPES}).alias("signature"),
        edge(F.array_min, "x").alias("min_x"), edge(F.array_min, "y").alias("min_y"), edge(F.array_max, "x").alias("max_x"), edge(F.array_max, "y").alias("max_y"),
    )


def schema_errors(lion: DataFrame, freq: DataFrame) -> list[str]:
    return [f"lines: missing {f}" for f in missing_fields(lion, LINE_FIELDS)] + [f"polygons: missing {f}" for f in vocab.TYPE_FIELDS.values() if f not in freq.columns]


def blank_counts(freq: DataFrame) -> DataFrame:
    """Rows (field, blanks) of the schedule fields."""
    counts = [F.count_if(F.col(f).isNull() | (F.trim(f) == "")) if f in freq.columns else F.count("*") for f in vocab.TYPE_FIELDS.values()]
    wide = freq.agg(*(c.alias(f) for c, f in zip(counts, vocab.TYPE_FIELDS.values(), strict=True)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("blanks")) for f in vocab.TYPE_FIELDS.values()))).alias("r")).select("r.*")


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")
