"""Sources over a fake service, evidence gates, validators and an end-to-end build from GeoJSON to a served release."""

import io
import json
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from sidetrace import __main__ as cli
from sidetrace import vocab
from sidetrace.operators import recovery, release, sides, validate
from sidetrace.plans import serve
from sidetrace.sources import service
from sidetrace.streaming import refresh


def fake(ids=(10, 2, 1), change=None, drop=None, twice=None):
    calls = {"count": 0}

    def fetch(url, q, post):
        if not url.endswith("/query"):
            calls["count"] += 1
            edited = 5 if calls["count"] == 1 or change != "edit" else 6
            return {"fields": [{"name": "OBJECTID", "type": "esriFieldTypeOID"}], "maxRecordCount": 2, "currentVersion": 11, "editingInfo": {"lastEditDate": edited}}
        if "returnCountOnly" in q:
            return {"count": len(ids)}
        if "returnIdsOnly" in q:
            return {"objectIds": list(ids)}
        page = [{"type": "Feature", "properties": {"objectid": int(i)}, "geometry": None} for i in reversed(q["objectIds"].split(",")) if i != drop]
        return {"features": page + (page[:1] if twice else [])}

    return fetch


def test_snapshots_are_whole_or_refused(tmp_path):
    out = f"{tmp_path}/s.json"
    assert service.snapshot("L", out, fake())["record_count"] == 3
    assert [f["properties"]["objectid"] for f in json.load(open(out))["features"]] == [1, 10, 2]
    for bad in (fake(drop="10"), fake(change="edit"), fake(twice=True), fake(ids=(1, 1)), fake(ids=()), lambda *a: {"error": {"code": 1}}):
        with pytest.raises(service.SourceError):
            service.snapshot("L", f"{tmp_path}/bad.json", bad)
    assert not (tmp_path / "bad.json").exists()
    keyed = service.keyed_subset("L", "K", ["2", "1", "2"], lambda u, q, p: {"features": [{"properties": {"k": 1}}, {"properties": {"K": 2}}]})
    assert [service.property_of(f, "k") for f in keyed] == ["1", "2"]


def test_downloads_and_archives(tmp_path):
    class Answer(io.BytesIO):
        def __init__(self, data, size):
            super().__init__(data)
            self.headers = {"Content-Length": size}

    assert service.download("u", f"{tmp_path}/f", lambda u: Answer(b"abc", "3")) == 3
    with pytest.raises(service.SourceError):
        service.download("u", f"{tmp_path}/g", lambda u: Answer(b"abc", "4"))
    for names, ok in ((["x/a.gdb/1", "x/a.gdb/2"], True), (["a.gdb/1", "b.gdb/1"], False), (["t.txt"], False), (["../a.gdb/1"], False)):
        with zipfile.ZipFile(f"{tmp_path}/z.zip", "w") as z:
            for n in names:
                z.writestr(n, "")
        if ok:
            assert service.single_folder(f"{tmp_path}/z.zip") == "x/a.gdb"
        else:
            with pytest.raises(service.SourceError):
                service.single_folder(f"{tmp_path}/z.zip")


POINT = dict.fromkeys(recovery.POINT_FLAGS, True) | {"component_length_feet": 100.0, "best_distance_feet": 20.0, "runner_up_distance_feet": 60.0, "projection_from_start_feet": 10.0, "projection_from_end_feet": 90.0, "contradictory_point_count": 0}
GAP = dict.fromkeys(recovery.GAP_FLAGS, True) | {"different_signature_within_3_feet": False, "endpoint_distance_feet": 0.1, "hausdorff_feet": 0.25, "length_ratio": 1.0, "projected_span_ratio": 0.99, "current_coverage_ratio": 0.99, "uncovered_length_feet": 3.0, "cscl_exact_coverage_ratio": 0.995, "schedule_signature_count": 1}


@pytest.mark.parametrize(("good", "gate", "breaks"), [(POINT, recovery.address_point_passes, {"best_distance_feet": 76.0, "runner_up_distance_feet": 44.0, "projection_from_start_feet": 9.0, "parity_agrees": False, "contradictory_point_count": 1}), (GAP, recovery.micro_gap_passes, {"hausdorff_feet": 0.26, "length_ratio": 1.02, "different_signature_within_3_feet": True, "schedule_signature_count": 2})])
def test_evidence_fails_closed(spark, good, gate, breaks):
    neutral = ("component_length_feet", "runner_up_distance_feet")  # no length asks for no margin, no runner-up is infinitely far
    rows = [good, *({**good, k: v} for k, v in breaks.items()), *({**good, k: None} for k in good if k not in neutral)]
    kind = {bool: "boolean", float: "double", int: "long"}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kind[type(v)]}" for k, v in good.items()))
    assert [r.ok for r in df.select(gate().alias("ok")).collect()] == [True] + [False] * (len(rows) - 1)


def test_shadow_report_never_promotes(spark):
    names = spark.createDataFrame([("LION 26C",), ("lion_26c.zip",), ("PAD 26b",)], "name string")
    pattern = "(?i)(2[0-9][A-D])"
    assert recovery.release_identifier(names, pattern, "lion") == "26C" and recovery.release_identifier(names, pattern) is None
    r = recovery.shadow_report("26C", "26B", {"a": 1}, {"a": 2})
    assert r["promoted_count"] == 0 and not r["promotion_enabled"] and len(r["blocking_reasons"]) == 4


def test_build_publish_serve(spark, tmp_path, monkeypatch, capsys):
    x, y = -73.943185, 40.715616
    # state plane feet, as the overlay works in
    line = {"type": "Feature", "properties": {"Street": "TEST STREET", "SegmentID": "s1", "LBlockFaceID": "left-1", "RBlockFaceID": "right-1", "LBoro": "1", "RBoro": "1", "SegmentTyp": "B", "FeatureTyp": "0", "Status": "2", "NonPed": "", "FromLeft": 0, "ToLeft": 0, "FromRight": 0, "ToRight": 0}, "geometry": {"type": "LineString", "coordinates": [[1_000_000, 200_000], [1_000_300, 200_000]]}}
    box = lambda i, a, b, day: {"type": "Feature", "properties": {"OBJECTID": i, "FREQ_REFUSE": day, "FREQ_RECYCLING": "Tue", "FREQ_ORGANICS": None, "FREQ_BULK": "Fri"}, "geometry": {"type": "Polygon", "coordinates": [[[999_900, a], [1_000_400, a], [1_000_400, b], [999_900, b], [999_900, a]]]}}
    for name, fs in (("lines", [line]), ("polys", [box(1, 200_000.5, 200_100, "Mon, Thu"), box(2, 199_900, 199_999.5, "Wed")])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    root = f"{tmp_path}/root"
    monkeypatch.setattr(vocab, "MAX_ZOOM", 15)
    monkeypatch.setattr(sys, "argv", ["sidetrace", "build", "--lines", f"{tmp_path}/lines.json", "--polygons", f"{tmp_path}/polys.json", "--root", root, "--version", "v1", "--retrieved-at", "2026-01-01"])
    assert cli.main() == 0
    audit = json.loads(capsys.readouterr().out.splitlines()[0])
    assert audit["passed"] and audit["outcomes"]["matched"] == 2 and validate.audit(audit) == []
    assert validate.audit(audit | {"fatal": 1}) and validate.audit(audit | {"passed": False})
    t = release.load(spark, root)
    found = serve.streets(t["block_faces"], t["collection_schedules"], "THU", "REFUSE", (x - 0.01, y - 0.01, x + 0.01, y + 0.01)).collect()
    assert [(r.block_face_id, r.weekdays) for r in found] == [("left-1", ["MON", "THU"])]
    health = {(r.section, r.name): r.n for r in serve.health(t["collection_schedules"], t["block_face_collection_states"], t["unknown_block_faces"]).collect()}
    assert health["type", "REFUSE"] == 3 and health["state", "POLICY_DERIVED"] == 2 and health["state", "NO_SERVICE"] == 0
    zooms = tuple(sorted(r.z for r in t["tiles"].select("z").distinct().collect()))
    assert validate.tiles(t["tiles"], t["faces_wide"], zooms).collect() == []
    ghost = t["faces_wide"].where("feature_id <> 'left-1'")
    assert {r.rule for r in validate.tiles(t["tiles"], ghost, zooms).collect()} == {"ghost"}
    tampered = t["block_faces"].withColumn("street_name", F.when(F.col("block_face_id") == "left-1", "X").otherwise(F.col("street_name")))
    assert [tuple(r) for r in validate.same_tables(t["block_faces"], tampered, "block_face_id", ["street_name", "side"]).collect()] == [("mismatched", "left-1")]


def test_refresh_runs_each_snapshot_once(spark, tmp_path):
    seen = []
    for k in range(3):
        spark.range(k + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: refresh.replay(spark, f"{tmp_path}/in", "id long", lambda df, n: seen.append((n, df.count())), f"{tmp_path}/c")
    run()
    run()
    assert [n for n, _ in seen] == [0, 1, 2] and sorted(c for _, c in seen) == [1, 2, 3]


def test_features_are_validated(spark):
    from tests.test_overlay import DOWN, LINE, POLY, UP, box, line

    o = sides.overlay(spark.createDataFrame([line()], LINE), spark.createDataFrame([box(0, *UP), box(1, *DOWN)], POLY))
    assert validate.features(o.features).collect() == []
    bad = o.features.withColumn("borough", F.lit("NOWHERE")).withColumn("lines", F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
    assert {r.rule for r in validate.features(bad).collect()} == {"unknown_borough", "bad_geometry"}
