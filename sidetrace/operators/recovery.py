"""Evidence gates for faces without a schedule, as Columns over evidence rows, and the shadow report that promotes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidetrace.operators import gates

# The flags that address-point and gap evidence must show, and the limits in feet and ratios.
POINT_FLAGS = ("borough_agrees", "actual_b7sc_agrees", "decoded_side_agrees", "geometric_side_agrees", "house_range_agrees", "parity_agrees", "unique_nearest_same_b7sc_component")
POINT_DISTANCE, POINT_MARGIN, POINT_RATIO = 75.0, 25.0, 1.5
GAP_FLAGS = ("unique_physicalid_match", "current_single_unbranched_path", "cscl_single_unbranched_path", "covered_signature_agrees_all_four")
GAP_NEAR, GAP_RATIO, GAP_UNCOVERED, GAP_COVERED, GAP_EXACT = 0.25, (0.99, 1.01), 3.0, 0.99, 0.995
PROHIBITED = ("nearest_polygon", "neighboring_street", "segment_id_only", "blank_source_value", "legacy_dsny_cscl_identity")


def _number(name: str, missing: float) -> Column:
    return F.coalesce(F.col(name), F.lit(missing))


def address_point_passes() -> Column:
    """Whether a row of address-point evidence passes every gate; what is missing fails."""
    length, best, next_ = _number("component_length_feet", 0.0), _number("best_distance_feet", float("inf")), _number("runner_up_distance_feet", float("inf"))
    margin = F.least(F.lit(20.0), length * 0.10)
    limits = [
        best <= POINT_DISTANCE, _number("projection_from_start_feet", -1.0) >= margin, _number("projection_from_end_feet", -1.0) >= margin,
        next_ - best >= POINT_MARGIN, next_ >= best * POINT_RATIO, F.col("contradictory_point_count") == 0,
    ]
    return gates.all_evidence(dict.fromkeys(POINT_FLAGS, True), limits)


def micro_gap_passes() -> Column:
    """Whether a row of gap evidence shows a tiny gap in an otherwise covered path; what is missing fails."""
    far = float("inf")
    limits = [
        _number("endpoint_distance_feet", far) <= GAP_NEAR, _number("hausdorff_feet", far) <= GAP_NEAR, _number("length_ratio", 0.0).between(*GAP_RATIO), _number("projected_span_ratio", 0.0).between(*GAP_RATIO),
        _number("current_coverage_ratio", 0.0) >= GAP_COVERED, _number("uncovered_length_feet", far) <= GAP_UNCOVERED, _number("cscl_exact_coverage_ratio", 0.0) >= GAP_EXACT, F.col("schedule_signature_count") == 1,
    ]
    return gates.all_evidence({**dict.fromkeys(GAP_FLAGS, True), "different_signature_within_3_feet": False}, limits)


def release_identifier(names: DataFrame, pattern: str, source: str | None = None) -> str | None:
    """The one release that a pattern's first group finds in the texts (name), upper-cased; None if there are none or several."""
    rows = names if source is None else names.where(F.contains(F.lower("name"), F.lit(source.lower())))
    found = rows.select(F.explode(F.regexp_extract_all("name", F.lit(pattern), F.lit(1))).alias("r")).select(F.upper("r").alias("r")).distinct().limit(2).collect()
    return found[0].r if len(found) == 1 else None


def shadow_report(line_release: str | None, address_release: str | None, before: dict, after: dict) -> dict:
    """What stands against promotion; this report never promotes."""
    same, stable = bool(line_release and line_release == address_release), before == after
    reasons = [r for r, holds in (("PAD_LION_RELEASE_MISMATCH", not same), ("ADDRESSPOINT_SOURCE_MUTATED_DURING_QUERY", not stable)) if holds]
    return {
        "mode": "shadow", "lion_release": line_release, "pad_release": address_release, "releases_match": same, "source_metadata_stable": stable, "candidate_count": 0, "evaluated_count": 0, "promoted_count": 0,
        "promotion_enabled": False, "evaluation_status": "BLOCKED_BEFORE_ADDRESSPOINT_QUERY", "blocking_reasons": [*reasons, "TWO_STABLE_SHADOW_BUILDS_REQUIRED", "MANUAL_REVIEW_REQUIRED"], "prohibited_methods": list(PROHIBITED),
    }


def reason_counts(unknown: DataFrame) -> DataFrame:
    return unknown.groupBy("reason_code").agg(F.count("*").alias("n"))
