"""Scenarios of the side overlay on short lines and boxes at (1,000,000, 200,000) feet."""

import pytest
from pyspark.sql import functions as F

from sidetrace.operators import sides as S
from sidetrace.operators import store

X, Y = 1_000_000.0, 200_000.0
LINE = "Street string, SegmentID string, LBlockFaceID string, RBlockFaceID string, LBoro string, RBoro string, SegmentTyp string, FeatureTyp string, Status string, NonPed string, FromLeft int, ToLeft int, FromRight int, ToRight int, SpecAddr string, source_row long, lines array<array<struct<x:double,y:double>>>"
POLY = "frequency_row long, OBJECTID string, FREQ_REFUSE string, FREQ_RECYCLING string, FREQ_ORGANICS string, FREQ_BULK string, polys array<array<array<struct<x:double,y:double>>>>"


def line(row=0, points=((0, 0), (100, 0)), **kw):
    base = dict(Street="TEST STREET", SegmentID="segment-1", LBlockFaceID="left-1", RBlockFaceID="right-1", LBoro="1", RBoro="1", SegmentTyp="B", FeatureTyp="0", Status="2", NonPed="", FromLeft=0, ToLeft=0, FromRight=0, ToRight=0, SpecAddr=None)
    return (*(base | kw).values(), row, [[(X + a, Y + b) for a, b in points]])


def box(row, x0, y0, x1, y1, refuse="Mon, Thu", recycling="Tue", organics="Wed", bulk="Fri", oid=None):
    ring = [(X + x0, Y + y0), (X + x1, Y + y0), (X + x1, Y + y1), (X + x0, Y + y1)]
    return (row, oid or str(row + 1), refuse, recycling, organics, bulk, [[ring]])


def run(spark, lines, boxes):
    lion, freq = spark.createDataFrame(lines, LINE), spark.createDataFrame(boxes, POLY)
    o = S.overlay(lion, freq)
    sides = {(r.source_row, r.side): r for r in o.sides.collect()}
    return o, sides, S.audit(lion, freq, o)


UP, DOWN = (-50, 0.1, 150, 60), (-50, -60, 150, -0.1)


def test_sides_resolve_independently(spark):
    o, sides, audit = run(spark, [line()], [box(0, *UP), box(1, *DOWN, refuse="Tue, Fri")])
    assert sides[0, "LEFT"].outcome == sides[0, "RIGHT"].outcome == "matched" and audit["passed"]
    days = {r.block_face_id: r.REFUSE.days for r in o.features.collect()}
    assert days == {"left-1": ["MON", "THU"], "right-1": ["TUE", "FRI"]}
    t = store.tables(o.features, o.unknown, "test", "2026-01-01")
    assert store.violations(t).collect() == [] and t["block_faces"].count() == 2
    broken = dict(t, collection_schedules=t["collection_schedules"].withColumn("weekday", F.lit("SUN")))
    assert {r.rule for r in store.violations(broken).collect()} >= {"unknown_weekday"}


def test_split_and_merge_by_schedule(spark):
    halves = [box(0, -50, 0.1, 100, 60), box(1, 100, 0.1, 250, 60, refuse="Tue, Fri"), box(2, -50, -60, 100, -0.1), box(3, 100, -60, 250, -0.1)]
    o, sides, audit = run(spark, [line(points=((0, 0), (200, 0)))], halves)
    f = [(r.block_face_id, r.feature_key, r.dsny_object_ids) for r in o.features.orderBy("block_face_id", "feature_key").collect()]
    assert len(f) == 3 and f[2] == ("right-1", "right-1", ["3", "4"]) and all(k.startswith("left-1~") for _, k, _ in f[:2]) and audit["passed"]


def test_half_covered_side_still_emits(spark):
    o, sides, _ = run(spark, [line(points=((0, 0), (200, 0)))], [box(0, -50, 0.1, 100, 60), box(1, -50, -60, 250, -0.1)])
    left = sides[0, "LEFT"]
    assert left.outcome == "partially_outside_schedule_area" and left.coverage_ratio == pytest.approx(0.5) and left.covered == pytest.approx(100)
    assert o.features.count() == 2
    (u,) = o.unknown.collect()
    assert u.reason_code == "PARTIAL_COVERAGE" and u.lines[0][0].x == pytest.approx(X + 100) and u.lines[0][-1].x == pytest.approx(X + 200)


def test_outcomes_that_need_no_geometry(spark):
    lines = [
        line(0, LBlockFaceID="0", FromLeft=1, ToLeft=9), line(1, SegmentID="segment-2", SegmentTyp="R"), line(2, SegmentID="segment-3", Status="3"), line(3, SegmentID=" "),
        line(4, SegmentID="segment-4", LBoro=None, points=((0, 0), (100, 1))), line(5, SegmentID="segment-5", Street=None, points=((0, 0), (100, 2))), line(6, SegmentID="segment-6", points=((5, 5), (5, 5))),
    ]
    o, sides, audit = run(spark, lines, [box(0, *UP), box(1, *DOWN)])
    got = {k: r.outcome for k, r in sides.items()}
    assert got[0, "LEFT"] == "non_addressable" and got[0, "RIGHT"] == "matched" and got[1, "LEFT"] == got[2, "RIGHT"] == "out_of_scope" and got[3, "LEFT"] == "invalid"
    assert got[4, "LEFT"] == got[5, "RIGHT"] == got[6, "LEFT"] == "invalid" and got[4, "RIGHT"] == "matched"
    assert all(r["passed"] for r in audit["reconciliation"].values()) and not audit["passed"] and len(sides) == 14
    assert o.unknown.where("reason_code = 'MISSING_FACE_ID'").count() == 1


def test_aliases(spark):
    same = [line(0, Street="B STREET"), line(1, Street="A STREET"), line(2, Street="0 STREET", SpecAddr="X")]
    o, sides, _ = run(spark, same, [box(0, *UP), box(1, *DOWN)])
    assert [sides[i, "LEFT"].outcome for i in range(3)] == ["deduplicated_alias", "matched", "deduplicated_alias"]
    assert o.features.first().street_names == ["0 STREET", "A STREET", "B STREET"] and o.features.first().source_rows == [0, 1, 2]
    _, sides, _ = run(spark, [line(0), line(1, LBlockFaceID="other")], [box(0, *UP), box(1, *DOWN)])
    assert {r.outcome for r in sides.values()} == {"invalid"}
    _, sides, _ = run(spark, [line(0), line(1, LBoro="2")], [box(0, *UP), box(1, *DOWN)])
    assert {r.outcome for r in sides.values()} == {"invalid"}


def test_polygons_far_ambiguous_broken_and_near(spark):
    o, sides, audit = run(spark, [line()], [box(0, *UP), box(1, *DOWN), box(2, 9000, 9000, 9100, 9100)])
    assert audit["frequency_outcomes"] == {"used_valid": 2, "unused_valid": 1, "invalid": 0} and audit["fatal"] == 1
    _, sides, _ = run(spark, [line()], [box(0, *UP), box(1, *UP, refuse="Sat"), box(2, *DOWN)])
    assert sides[0, "LEFT"].outcome == "ambiguous" and sides[0, "RIGHT"].outcome == "matched"
    _, sides, audit = run(spark, [line()], [box(0, *UP, refuse="Mon, Funday"), box(1, *DOWN)])
    assert sides[0, "LEFT"].outcome == "invalid" and audit["frequency_outcomes"]["invalid"] == 1
    _, sides, _ = run(spark, [line()], [box(0, -50, 25.5, 150, 60), box(1, *DOWN)])
    assert sides[0, "LEFT"].outcome == "matched" and sides[0, "LEFT"].used_tolerance
    _, sides, _ = run(spark, [line()], [box(0, *UP, oid="7"), box(1, *DOWN, oid="7")])
    assert {r.outcome for r in sides.values()} == {"invalid"}
    _, sides, _ = run(spark, [line()], [box(0, *DOWN)])
    assert sides[0, "LEFT"].outcome == "outside_schedule_area"


def test_one_face_on_two_segments_and_two_boroughs(spark):
    two = [line(0), line(1, SegmentID="segment-2", points=((100, 0), (140, 0)))]
    o, _, _ = run(spark, two, [box(0, *UP), box(1, *DOWN)])
    left = o.features.where("block_face_id = 'left-1'").collect()
    assert len(left) == 1 and len(left[0].lines) == 2 and left[0].segment_ids == ["segment-1", "segment-2"]
    o, _, _ = run(spark, [two[0], line(1, SegmentID="segment-2", LBoro="3", points=((100, 0), (140, 0)))], [box(0, *UP), box(1, *DOWN)])
    assert o.features.where("block_face_id = 'left-1'").count() == 2


def test_organics_follow_recycling_or_conflict(spark):
    o, _, _ = run(spark, [line()], [box(0, *UP, organics=None), box(1, *DOWN, organics="Sat")])
    f = {r.block_face_id: r.ORGANICS for r in o.features.collect()}
    assert f["left-1"].state == "POLICY_DERIVED" and f["left-1"].days == ["TUE"] and not f["left-1"].source_policy_conflict
    assert f["right-1"].state == "SOURCE_EXPLICIT" and f["right-1"].source_policy_conflict


def test_missing_schema_keeps_every_side(spark):
    lion = spark.createDataFrame([line()], LINE).drop("Status")
    freq = spark.createDataFrame([box(0, *UP)], POLY)
    o = S.overlay(lion, freq)
    assert [r.outcome for r in o.sides.collect()] == ["invalid", "invalid"]
