import json
import os

import pytest
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.operators import gates, release
from sidetrace.operators import tiles as T
from sidetrace.plans import serve
from sidetrace.sources import geojson


@pytest.fixture(scope="module")
def features(spark):
    rows = [("f1", "faces", [[(-73.99, 40.71), (-73.985, 40.712), (-73.98, 40.71)]], {"days": "MON"}), ("f2", "faces", [[(-73.99, 40.71), (-73.99, 40.72)]], {}), ("u1", "unknown", [[(-73.97, 40.7), (-73.96, 40.7)]], {"reason": "X"}), ("dot", "faces", [[(-73.9, 40.7), (-73.9, 40.7)]], {})]
    return spark.createDataFrame(rows, "feature_id string, layer string, lines array<array<struct<x:double,y:double>>>, props map<string,string>")


def test_tiles(spark, features, tmp_path):
    zooms = (14, 16)
    built = T.build_tiles(features, zooms)
    again = T.build_tiles(features.repartition(5), zooms)
    key = lambda df: sorted((r.z, r.x, r.y, bytes(r.data)) for r in df.collect())
    assert key(built) == key(again)
    seen = T.decode_tiles(built)
    by = {(r.z, r.feature_id) for r in seen.collect()}
    assert by == {(14, "f1"), (14, "f2"), (16, "f1"), (16, "f2"), (16, "u1")}
    assert seen.where("feature_id = 'f1'").first().props == {"days": "MON"}
    assert [r.feature_id for r in T.lost_at_max_zoom(features, seen, 16).collect()] == ["dot"]
    assert gates.size_gate(built).isEmpty() and gates.size_gate(built, 10).count() == built.count()
    with pytest.raises(ValueError):
        gates.size_gate(built, vocab.MAX_TILE_BYTES + 1)
    built.write.partitionBy("z").parquet(f"{tmp_path}/tiles")
    stored = spark.read.parquet(f"{tmp_path}/tiles")
    r = built.where("z = 14").first()
    assert serve.tile(stored, r.z, r.x, r.y) == bytes(r.data) and serve.tile(stored, 14, 0, 0) is None
    with pytest.raises(serve.BadRequest):
        serve.tile(stored, 14, 1 << 14, 0)
    m = {r.z: (r.n, r.largest) for r in T.size_metrics(built.withColumn("b", F.length("data").cast("long")), "z", "b").collect()}
    assert m["ALL"][0] == built.count() and m["ALL"][1] == max(m["14"][1], m["16"][1])


def test_releases(spark, tmp_path):
    root = str(tmp_path)
    t = {"faces": spark.range(10)}
    release.publish(root, "v1", t)
    release.publish(root, "v2", {"faces": spark.range(12)}, gates.regression(release.counts(t), release.counts({"faces": spark.range(12)})))
    assert release.load(spark, root)["faces"].count() == 12 and release.load(spark, root, "v1")["faces"].count() == 10
    with pytest.raises(release.ReleaseError, match="gate"):
        release.publish(root, "v3", {"faces": spark.range(5)}, gates.regression(release.counts(t), release.counts({"faces": spark.range(5)})))
    assert release.read(root)["version"] == "v2" and not os.path.exists(f"{root}/releases/v3")
    for bad in ("v2", "../x", ""):
        with pytest.raises(release.ReleaseError):
            release.publish(root, bad, t)
    assert release.activate(root, "v1")["version"] == "v1"
    for k in range(4, 7):
        release.publish(root, f"v{k}", t)
    assert release.read(root)["history"] == ["v6", "v5", "v4"] and sorted(os.listdir(f"{root}/releases")) == ["v4", "v5", "v6"]
    part = next(n for n in os.listdir(f"{root}/releases/v6/faces") if n.endswith(".parquet"))
    with open(f"{root}/releases/v6/faces/{part}", "ab") as f:
        f.write(b"x")
    with pytest.raises(release.ReleaseError, match="digest"):
        release.load(spark, root)
    m = json.load(open(f"{root}/current.json"))
    for change in ({"manifest_version": 3}, {"version": "../x"}, {"artifacts": {"a": {"path": "/etc", "sha256": "0" * 64}}}, {"more": 1}):
        with open(f"{root}/current.json", "w") as f:
            json.dump(m | change, f)
        with pytest.raises(release.ReleaseError):
            release.read(root)


def test_geojson(spark, tmp_path):
    def put(name, features):
        path = f"{tmp_path}/{name}.json"
        with open(path, "w") as f:
            json.dump({"type": "FeatureCollection", "features": features}, f)
        return path

    line = lambda kind, c: {"type": "Feature", "properties": {"Street": "S", "n": 5}, "geometry": {"type": kind, "coordinates": c}}
    p = put("lines", [line("LineString", [[0, 0], [1, 2]]), line("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]), line("Point", [1, 1])])
    rows = geojson.read_lines(spark, p, ("Street", "n", "absent")).orderBy("source_row").collect()
    assert [r.lines and len(r.lines) for r in rows] == [1, 2, None] and rows[0].n == "5" and rows[0].absent is None
    assert geojson.read_lines(spark, p, ("Street",), 2).count() == 2
    with pytest.raises(ValueError):
        geojson.read_lines(spark, p, ("Street",), 0)
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    q = put("polys", [line("Polygon", [ring]), line("MultiPolygon", [[ring], [ring]])])
    assert [[len(x) for x in r.polys] for r in geojson.read_polygons(spark, q, ()).orderBy("frequency_row").collect()] == [[1], [1, 1]]
    with pytest.raises(ValueError):
        geojson.read_lines(spark, put("none", []), ())
    want, got = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("2",), ("2",), ("9",)], "id string")
    assert {(r.id, r.verdict) for r in geojson.snapshot_proof(want, got, "id").collect()} == {("1", "missing"), ("2", "repeated"), ("9", "unexpected")}
