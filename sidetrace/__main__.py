"""Command line: python -m sidetrace build|refresh|validate|status|promote|serve|activate|health ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from sidetrace import vocab
from sidetrace.operators import prepare, refresh, release, validate
from sidetrace.plans import serve
from sidetrace.session import session
from sidetrace.sources import geojson


def sources(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Lines and polygons in state plane feet; shapes in longitude and latitude are projected."""
    lion = geojson.read_lines(spark, a.lines, prepare.LINE_FIELDS + prepare.OPTIONAL_FIELDS, a.limit)
    freq = geojson.read_polygons(spark, a.polygons, ("OBJECTID", *vocab.TYPE_FIELDS.values(), "SCHEDULECODE", "SECTION", "DISTRICT"))
    return geojson.to_plane(lion, "lines").checkpoint(), geojson.to_plane(freq, "polys").checkpoint()


def build(a: argparse.Namespace) -> int:
    """A release from two files. A pilot has no floors to reach; a refresh has."""
    spark = session()
    if a.checkpoints:
        spark.sparkContext.setCheckpointDir(a.checkpoints)
    lion, freq = sources(spark, a)
    try:
        m = refresh.run(spark, lion, freq, a.root, a.version, a.retrieved_at, a.polygons, None if a.what == "refresh" else {}, a.as_of)
    except release.ReleaseError as e:
        print(json.dumps({"error": str(e)}))
        return 1
    t = release.load(spark, a.root, check=False)
    print(t["audit"].first()["audit"], end="")
    print(release.canonical_json({"version": m["version"], "counts": m["counts"]}), end="")
    return 0


def main() -> int:
    p = argparse.ArgumentParser(prog="sidetrace")
    sub = p.add_subparsers(dest="what", required=True)
    for what in ("build", "refresh"):
        b = sub.add_parser(what)
        for name in ("--lines", "--polygons", "--root", "--retrieved-at"):
            b.add_argument(name, required=True)
        b.add_argument("--version")
        b.add_argument("--limit", type=int)
        b.add_argument("--checkpoints")
        b.add_argument("--as-of", help="the day for the age of the policy")
    for what in ("validate", "status"):
        sub.add_parser(what).add_argument("--root", required=True)
    pro = sub.add_parser("promote")
    for name in ("--staging", "--root", "--version"):
        pro.add_argument(name, required=True)
    s = sub.add_parser("serve")
    s.add_argument("--root", required=True)
    s.add_argument("--day", required=True)
    s.add_argument("--types", default="REFUSE")
    s.add_argument("--box", type=float, nargs=4)
    act = sub.add_parser("activate")
    act.add_argument("--root", required=True)
    act.add_argument("--version", required=True)
    h = sub.add_parser("health")
    h.add_argument("--root", required=True)
    a = p.parse_args()
    if a.what in ("build", "refresh"):
        return build(a)
    if a.what == "validate":
        wrong = validate.bundle(session(), a.root)
        print(json.dumps(wrong))
        return int(bool(wrong))
    if a.what == "status":
        session()
        m = release.read(a.root)
        print(release.canonical_json({"version": m["version"], "history": m["history"], "counts": m["counts"], "checksums": release.Checksums().status(a.root, m, wait=True)}), end="")
        return 0
    if a.what == "promote":
        release.promote(a.staging, a.root, a.version)
        return 0
    if a.what == "activate":
        release.activate(a.root, a.version)
        return 0
    spark = session()
    t = release.load(spark, a.root)
    if a.what == "health":
        serve.health(t["collection_schedules"], t["block_face_collection_states"], t["unknown_block_faces"]).orderBy("section", "name").show(100, False)
    else:
        serve.streets(t["block_faces"], t["collection_schedules"], a.day, a.types, tuple(a.box) if a.box else None, vocab.STREET_CAP).show(100, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
