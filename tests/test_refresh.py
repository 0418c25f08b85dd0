"""A refresh from longitude and latitude to a served release, what its gates refuse, and the checks of a published one."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sidetrace.functions import geo as G
from sidetrace.functions import text as T
from sidetrace.operators import prepare, refresh, relate, release, sinks, store, validate
from sidetrace.plans import serve
from sidetrace.sources import geojson, service
from tests.test_overlay import DOWN, LINE, POLY, UP, box, line

ZOOMS = (15, 16)


def sources(spark, lines, boxes):
    """The rows with their shapes in longitude and latitude, as snapshots have them, and back in the plane."""
    lion = spark.createDataFrame(lines, LINE).withColumn("lines", G.project(F.col("lines"), G.plane_to_lonlat))
    freq = spark.createDataFrame(boxes, POLY).withColumn("polys", G.project_polygons(F.col("polys"), G.plane_to_lonlat))
    assert abs(lion.select(F.col("lines")[0][0]["x"]).first()[0] + 73.94) < 0.01
    return geojson.to_plane(lion, "lines").checkpoint(), geojson.to_plane(freq, "polys").checkpoint()


FLOORS = {"raw_lion_rows": 2, "dsny_frequency_rows": 2, "output_features": 2}


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("root"))
    rows = [line(), line(1, ((0, 300), (100, 300)), SegmentID="segment-2", LBlockFaceID="", RBlockFaceID="right-2", RBoro="1")]
    boxes = [box(0, -50, 0.1, 150, 400), box(1, *DOWN, refuse="Tue, Fri")]
    m = refresh.run(spark, *sources(spark, rows, boxes), root, "v1", "2026-01-01", "test", FLOORS, "2026-09-01", ZOOMS)
    return root, m, release.load(spark, root)


def test_a_release_is_whole_and_served(spark, published):
    root, m, t = published
    c = m["counts"]
    assert (c["raw_lion_rows"], c["matched_sides"], c["output_features"], c["tile_features"], c["unknown_features"], c["schedule_rows_REFUSE"]) == (2, 3, 3, 3, 1, 6)
    assert validate.bundle(spark, root) == []
    found = serve.streets(t["block_faces"], t["collection_schedules"], "THU", "REFUSE", (-74.0, 40.6, -73.9, 40.8)).collect()
    assert sorted(r.block_face_id for r in found) == ["left-1", "right-2"]
    layers = {(r.layer, r.z) for r in validate.T.decode_tiles(t["tiles"]).collect()}
    assert layers == {("faces", 15), ("faces", 16), ("unknown", 16)}
    one = t["block_face_lion_components"].where("block_face_id = 'left-1'").first()
    assert one.segment_id == "segment-1" and one.component_index == 0 and json.loads(one.source_records_json)[0]["street"] == "TEST STREET"
    assert {(r.block_face_id, r.dsny_object_id, r.frequency_row) for r in t["block_face_dsny_sources"].collect()} == {("left-1", "1", 0), ("right-1", "2", 1), ("right-2", "1", 0)}
    meta = sinks.read_metadata(t["tile_metadata"])
    assert meta["unknown_feature_count"] == 1 and meta["feature_count"] == 3 and meta["data_updated"] == "2026-01-01" and len(meta) >= 27 and meta["bounds"][0] < meta["bounds"][2]
    assert sinks.source_version("x", t["tile_metadata"], "d") == "x" and sinks.source_version(None, t["tile_metadata"].where("name = 'none'"), "d") == "d"
    assert sinks.source_version(None, t["tile_metadata"], "d") == meta["source_sha256"]


def test_tiles_are_answered_by_version(published):
    _, m, t = published
    z, x, y = t["tiles"].select("z", "x", "y").first()
    status, headers, body = serve.tile_response(t["tiles"], "v1", "v1", z, x, y)
    assert status == 200 and body[:2] == b"\x1f\x8b" and headers["Content-Encoding"] == "gzip"
    assert serve.tile_response(t["tiles"], "v1", "v1", z, x, y, f'"x", W/{headers["ETag"]}')[0] == 304
    assert serve.tile_response(t["tiles"], "v1", "v1", z, 0, 0)[0] == 204 and serve.tile_response(t["tiles"], "v1", "v2", z, x, y)[0] == 404
    assert serve.tile_response(t["tiles"], None, "v1", z, x, y)[0] == 503 and serve.tile_response(t["tiles"], "v1", "v1", 99, x, y)[0] == 404


def test_a_drop_a_broken_audit_and_an_old_policy_are_refused(spark, published):
    root, m, _ = published
    few = refresh.regression(spark, m["counts"], m["counts"] | {"schedule_rows_BULK": 2}, FLOORS)
    assert [(r.metric, r.verdict) for r in few.where("verdict <> 'ok'").collect()] == [("schedule_rows_BULK", "dropped")]
    assert {r.verdict for r in refresh.regression(spark, {}, m["counts"], None).collect()} == {"below_floor", "ok"}
    two = sources(spark, [line()], [box(0, *UP), box(1, *DOWN)])
    with pytest.raises(release.ReleaseError, match="gate"):
        refresh.run(spark, *two, root, "v2", "2026-01-02", "test", {}, None, ZOOMS)
    with pytest.raises(release.ReleaseError, match="policy"):
        refresh.run(spark, *two, root, "v2", "2026-01-02", "test", {}, "2029-01-01", ZOOMS)
    with pytest.raises(release.ReleaseError, match="audit"):
        refresh.run(spark, *sources(spark, [line()], [box(0, 5000, 5000, 5100, 5100)]), root, "v2", "2026-01-02", "test", {}, None, ZOOMS)
    assert release.read(root)["version"] == "v1" and release.Store(root).names("releases") == ["v1"]


def test_damage_is_seen(spark, published, tmp_path):
    root, m, t = published
    assert release.Checksums().status(root, m, wait=True) == "verified"
    other = f"{tmp_path}/other"
    release.promote(root, other, "w1")
    assert validate.bundle(spark, other)[:1] == ["metadata: version isn't what the tiles say"]
    folder = f"{other}/releases/w1/tiles/z=16"
    part = next(n for n in os.listdir(folder) if n.endswith(".parquet"))
    with open(f"{folder}/{part}", "r+b") as f:  # one byte in a partition's folder
        f.seek(8)
        byte = f.read(1)
        f.seek(8)
        f.write(bytes([byte[0] ^ 1]))
    again = release.read(other)
    assert release.Checksums().status(other, again, wait=True) == "invalid" and validate.bundle(spark, other) == ["tiles doesn't match its digest"]
    with pytest.raises(release.ReleaseError, match="digest"):
        release.load(spark, other)
    del again["counts"]
    old = release.Store(f"{tmp_path}/old")
    old.put(release.canonical_json({**again, "manifest_version": 1}), "current.json")
    assert release.read(f"{tmp_path}/old")["counts"] == {}


def test_loads_are_cross_checked(spark, published):
    t = published[2]
    assert store.load_errors(t).collect() == []
    assert store.load_wide(t).where("feature_id = 'right-1'").first().refuse_days == "TUE,FRI"
    fewer = dict(t, collection_schedules=t["collection_schedules"].where("weekday <> 'THU'"), block_face_dsny_sources=t["block_face_dsny_sources"].where("block_face_id <> 'left-1'"))
    assert {(r.rule, r.id) for r in store.load_errors(fewer).collect()} >= {("days_differ", "left-1"), ("no_sources", "left-1"), ("days_differ", "right-2")}
    mixed = t["collection_schedules"].withColumn("source", F.when(F.col("weekday") == "MON", "a").otherwise("b"))
    assert {r.rule for r in store.load_errors(dict(t, collection_schedules=mixed)).collect()} == {"several_sources"}
    gap = t["block_face_lion_components"].withColumn("component_index", F.col("component_index") + 1)
    assert {r.rule for r in store.load_errors(dict(t, block_face_lion_components=gap)).collect()} == {"component_gap"}
    louder = refresh.tile_layers(t).withColumn("props", F.transform_values("props", lambda k, v: F.concat(v, F.lit("!"))))
    assert {r.rule for r in validate.tile_layers(t["tiles"], louder, ZOOMS).collect()} == {"value_differs"}


def test_metadata_is_typed(spark, published):
    good = published[2]["tile_metadata"]
    for name, value in (("maxzoom", "-1"), ("json", "[1]"), ("bounds", "1,2,x,4"), ("bounds", "9,1,2,3"), ("format", "png")):
        with pytest.raises(sinks.MetadataError):
            sinks.read_metadata(sinks.upsert(good, {name: value}))
    with pytest.raises(sinks.MetadataError, match="repeated"):
        sinks.read_metadata(good.union(good))


def test_small_functions(spark):
    row = spark.range(1).select(*(T.format_bytes(F.lit(n)).alias(str(n)) for n in (5, 1536, 3 << 20))).first()
    assert tuple(row) == ("5 B", "1.5 KB", "3.0 MB")
    lines = F.from_json(F.lit('[[{"x":0,"y":0},{"x":1,"y":0}],[{"x":0,"y":0},{"x":3,"y":4}],[{"x":9,"y":0},{"x":9,"y":5}]]'), "array<array<struct<x:double,y:double>>>")
    assert [(p.x, p.y) for p in spark.range(1).select(G.longest(lines)).first()[0]] == [(0, 0), (3, 4)]
    lion = spark.createDataFrame([line(0), line(1, ((0, 5), (9, 9))), line(2, SegmentID="s2")], LINE)
    assert [(r.segment_id, r.n_geometries, r.source_rows) for r in prepare.multi_geometry(lion).collect()] == [("segment-1", 2, [0, 1])]
    df = spark.createDataFrame([(10,), (9,), (1,)], "k int")
    assert [r.k for r in relate.first_by_text(df, "k", 2).collect()] == ["1", "10"] and relate.over_cap(df, 2) and not relate.over_cap(df, 3)


def test_features_one_a_line(spark, tmp_path):
    path = f"{tmp_path}/lines.ndjson"
    with open(path, "w") as f:
        for i in range(5):
            f.write(json.dumps({"type": "Feature", "properties": {"Street": f"S{i}"}, "geometry": {"type": "LineString", "coordinates": [[i, 0], [i, 1]]}}) + "\n")
    rows = geojson.read_line_features(spark, path, ("Street",)).orderBy("source_row").collect()
    assert [(r.source_row, r.Street, r.lines[0][0].x) for r in rows] == [(i, f"S{i}", float(i)) for i in range(5)]
    sinks.write_features(spark.createDataFrame([("b", 1), ("a", None)], "feature_key string, n int"), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"feature_key":"a","n":null}', '{"feature_key":"b","n":1}']


def test_service_proofs():
    layer = {"id": 3, "name": "n", "objectIdField": "OBJECTID", "editingInfo": {"lastEditDate": 7}}

    def fetch(url, q, post):
        return {"objectIds": [1, 2]} if "returnIdsOnly" in q else {"features": [{"a": 1}, {"a": 2}]} if url.endswith("/query") else layer

    features = [{"properties": {"OBJECTID": 1}}, {"properties": {"objectid": 2}}]
    service.keyed_proof("L", "K", ["5"], features, fetch)
    for bad in (features[:1], features * 2, [*features, {"properties": {"OBJECTID": 9}}]):
        with pytest.raises(service.SourceError):
            service.keyed_proof("L", "K", ["5"], bad, fetch)
    told = service.remote_metadata("L", fetch)
    assert len(told) == 9 and told["last_edit_ms"] == 7 and told["geometry_type"] is None
    with pytest.raises(service.SourceError):
        service.sample("L", "/nowhere", 101, fetch=fetch)
