import pytest
from pyspark.sql import functions as F

from sidetrace.functions import geo as G
from sidetrace.functions import text as T
from sidetrace.operators import digest as D
from sidetrace.operators import gates
from sidetrace.operators.ordering import numbered
from sidetrace.operators.rangejoin import box_join, interval_join, merged_intervals
from sidetrace.plans import serve


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "days"),
    [("Mon, Thu", ["MON", "THU"]), ("Thursday / Monday", ["MON", "THU"]), ("thurs;TUES,thur", ["TUE", "THU"]), ("A", None), ("Mon, Funday", None), ("Mondaygarbage", None), ("Mon,", None), ("Sunday", None), (" ", None), (None, None)],
)
def test_days(spark, value, days):
    assert one(spark, T.days, value) == days
    assert (one(spark, T.day_error, value) is None) == (days is not None)


def test_text(spark):
    assert one(spark, T.clean_text, " a \t b\n") == "a b" and one(spark, T.clean_text, None) == ""
    assert one(spark, T.clean_identifier, 12.0, "double") == "12" and one(spark, T.source_code, " b ") == "B"
    assert [one(spark, T.is_non_addressable, v) for v in (None, "", "0", "0.0", "none", "<NA>", "00", "7")] == [True] * 7 + [False]
    assert [one(spark, T.borough_name, v) for v in ("1", "5.0", "6", "x", "inf", None)] == ["MANHATTAN", "STATEN ISLAND", None, None, None, None]
    assert [one(spark, T.usable_address, v) for v in ("12-34", "0", "00-00", None)] == [True, False, False, False]
    assert one(spark, lambda v: T.unique_match(v, "[0-9]+"), "a12 b12") == "12" and one(spark, lambda v: T.unique_match(v, "[0-9]+"), "a1 b2") is None
    assert one(spark, T.html_escape, "<a b=\"c\">&'") == "&lt;a b=&quot;c&quot;&gt;&amp;&#39;"
    lines = one(spark, T.parse_wkt, "MULTILINESTRING ((0 1, 2 3), (4 5), (1 1 1, 2 2 2))")
    assert [[(p.x, p.y) for p in line] for line in lines] == [[(0, 1), (2, 3)]]
    assert one(spark, lambda v: T.to_wkt(T.parse_wkt(v)), "LINESTRING(0 1,2 3)") == "LINESTRING (0.0 1.0,2.0 3.0)" and one(spark, T.parse_wkt, "POINT (1 2)") is None


def test_projections_go_there_and_back(spark):
    df = spark.createDataFrame([(1_000_000.0, 200_000.0), (913_000.0, 121_000.0)], "x double, y double")
    lon, lat = G.plane_to_lonlat(F.col("x"), F.col("y"))
    df = df.withColumn("lon", lon).withColumn("lat", lat)
    x, y = G.lonlat_to_plane(F.col("lon"), F.col("lat"))
    for r in df.select("*", x.alias("x2"), y.alias("y2")).collect():
        assert r.x2 == pytest.approx(r.x, abs=1e-3) and r.y2 == pytest.approx(r.y, abs=1e-3)
    first = df.first()
    assert first.lon == pytest.approx(-73.943185, abs=1e-5) and first.lat == pytest.approx(40.715616, abs=1e-5)


def test_range_joins_equal_nested_loops(spark):
    a = spark.range(60).selectExpr("id", "(id * 37 % 100) / 3.0D AS min_x", "(id * 53 % 90) / 3.0D AS min_y", "(id * 37 % 100) / 3.0D + id % 5 AS max_x", "(id * 53 % 90) / 3.0D + id % 4 AS max_y")
    b = spark.range(40).selectExpr("id", "(id * 29 % 100) / 3.0D AS min_x", "(id * 71 % 90) / 3.0D AS min_y", "(id * 29 % 100) / 3.0D + id % 3 AS max_x", "(id * 71 % 90) / 3.0D + id % 6 AS max_y")
    for pad, cell in ((0.0, 2.0), (1.5, 0.7)):
        got = sorted((r.l_id, r.r_id) for r in box_join(a, b, cell, pad).collect())
        want = sorted((p.id, q.id) for p in a.collect() for q in b.collect() if p.max_x + pad >= q.min_x and p.min_x - pad <= q.max_x and p.max_y + pad >= q.min_y and p.min_y - pad <= q.max_y)
        assert got == want and want
    u, v = (t.select("id", F.col("min_x").alias("lo"), F.col("max_x").alias("hi")) for t in (a, b))
    assert sorted((r.l_id, r.r_id) for r in interval_join(u, v, 1.3).collect()) == sorted((p.id, q.id) for p in u.collect() for q in v.collect() if p.lo <= q.hi and q.lo <= p.hi)
    m = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("a", 1, 2), ("b", 3, 4)], "k string, lo int, hi int")
    assert sorted(tuple(r) for r in merged_intervals(m, ["k"]).collect()) == [("a", 0, 7), ("a", 9, 10), ("b", 3, 4)]


def test_numbering_digests_and_gates(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("id"))
    assert [r.id for r in numbered(ids.repartition(7), "id").orderBy("number").collect()] == sorted(str(i) for i in range(500))
    d = ids.withColumn("d", F.sha2("id", 256))
    assert D.aggregate_digest(d, "id", "d").first() == D.aggregate_digest(d.repartition(9), "id", "d").first() != D.aggregate_digest(d.where("id <> '7'"), "id", "d").first()
    assert D.aggregate_digest(d.limit(0), "id", "d").first().n == 0
    old, new = (spark.createDataFrame(r, "metric string, n long") for r in ([("a", 100), ("b", 100), ("c", 5)], [("a", 90), ("b", 89), ("d", 1)]))
    assert {r.metric: r.verdict for r in gates.regression(old, new, {"d": 2}).collect()} == {"a": "ok", "b": "dropped", "c": "dropped", "d": "below_floor"}
    assert [one(spark, lambda v: gates.policy_age(v.cast("date")), v) for v in ("2026-09-01", "2027-03-01", "2027-09-01")] == ["ok", "warn", "block"]
    e = spark.createDataFrame([(True, 10.0, 40.0, 50.0, 200.0), (True, 10.0, 20.0, 50.0, 200.0), (None, 10.0, None, 50.0, 200.0)], "flag boolean, best double, next double, at double, whole double")
    gate = gates.all_evidence({"flag": True}, [gates.clear_winner(F.col("best"), F.col("next")), gates.endpoint_margin(F.col("at"), F.col("whole"))])
    assert [r.g for r in e.select(gate.alias("g")).collect()] == [True, False, False]
    with pytest.raises(Exception, match="unknown outcome"):
        gates.outcome_counts(spark.createDataFrame([("x",)], "outcome string"), "outcome", ("y",)).collect()


def test_serving_checks_its_parameters(spark):
    faces = spark.createDataFrame([("f", "S", 0.0, 0.0, 1.0, 1.0), ("g", "T", 5.0, 5.0, 6.0, 6.0)], "block_face_id string, street_name string, min_x double, min_y double, max_x double, max_y double")
    days = spark.createDataFrame([("f", "REFUSE", "MON"), ("f", "REFUSE", "FRI"), ("g", "REFUSE", "MON"), ("g", "BULK", "TUE")], "block_face_id string, collection_type string, weekday string")
    assert [(r.block_face_id, r.weekdays) for r in serve.streets(faces, days, "mon", "REFUSE,REFUSE", (1, 1, 2, 2)).collect()] == [("f", ["FRI", "MON"])]
    for bad in (dict(day="SUN"), dict(day="MON", types="PAPER"), dict(day="MON", box=(2, 0, 1, 1)), dict(day="MON", box=(0, 0, float("nan"), 1))):
        with pytest.raises(serve.BadRequest):
            serve.streets(faces, days, **bad)
    with pytest.raises(serve.TooMany):
        serve.streets(faces, days, "MON", cap=1)
    assert serve.map_config(None, None)["available"] is False
