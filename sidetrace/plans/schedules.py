"""Schedule, identifier and predicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.functions import text as T
from sidetrace.operators import gates, prepare, recovery
from sidetrace.plans import serve
from sidetrace.plans.base import Registry, days_sql, raw, table

R = Registry()


@R.add(f"SELECT c_custkey, array_to_string(d, ',') AS day_list, CASE WHEN d IS NULL THEN 'UNKNOWN_SOURCE_BLANK' ELSE 'SOURCE_EXPLICIT' END AS state FROM (SELECT c_custkey, {days_sql('r')} AS d FROM (SELECT c_custkey, {raw('c_custkey')} AS r FROM customer))")
def q_schedule_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(raw("c_custkey")).alias("r"))
    d = T.days(F.col("r"))
    return c.select("c_custkey", F.array_join(d, ",").alias("day_list"), F.when(d.isNull(), vocab.BLANK).otherwise(vocab.EXPLICIT).alias("state"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.expr(raw("c_custkey")).alias("raw_refuse"), F.expr(raw("(c_custkey // 8)").replace("//", "div")).alias("raw_recycling"), F.expr(raw("(c_custkey // 64)").replace("//", "div")).alias("raw_organics"))
    return c.select("c_custkey", "c_nationkey", T.schedule_state("REFUSE", F.col("raw_refuse")).alias("REFUSE"), T.schedule_state("RECYCLING", F.col("raw_recycling")).alias("RECYCLING"), T.schedule_state("ORGANICS", F.col("raw_organics"), F.col("raw_recycling")).alias("ORGANICS"))


_STATES_SQL = f"""SELECT c_custkey, c_nationkey, rf, ry, CASE WHEN og IS NULL AND ry IS NOT NULL THEN ry ELSE og END AS od,
CASE WHEN rf IS NULL THEN 'UNKNOWN_SOURCE_BLANK' ELSE 'SOURCE_EXPLICIT' END AS rf_state,
CASE WHEN ry IS NULL THEN 'UNKNOWN_SOURCE_BLANK' ELSE 'SOURCE_EXPLICIT' END AS ry_state,
CASE WHEN og IS NOT NULL THEN 'SOURCE_EXPLICIT' WHEN ry IS NOT NULL THEN 'POLICY_DERIVED' ELSE 'UNKNOWN_SOURCE_BLANK' END AS og_state,
CASE WHEN og IS NOT NULL AND ry IS NOT NULL AND og <> ry THEN 'true' ELSE 'false' END AS conflict FROM
(SELECT c_custkey, c_nationkey, {days_sql('a')} AS rf, {days_sql('b')} AS ry, {days_sql('c')} AS og FROM
(SELECT c_custkey, c_nationkey, {raw('c_custkey')} AS a, {raw('(c_custkey // 8)')} AS b, {raw('(c_custkey // 64)')} AS c FROM customer))"""


@R.add(f"SELECT c_custkey, coalesce(array_to_string(ry, ','), '') AS recycling_days, coalesce(array_to_string(od, ','), '') AS organics_days, ry_state AS recycling_state, og_state AS organics_state, conflict AS policy_conflict FROM ({_STATES_SQL})")
def q_schedule_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    return s.select("c_custkey", F.array_join("RECYCLING.days", ",").alias("recycling_days"), F.array_join("ORGANICS.days", ",").alias("organics_days"), F.col("RECYCLING.state").alias("recycling_state"), F.col("ORGANICS.state").alias("organics_state"), F.col("ORGANICS.source_policy_conflict").cast("string").alias("policy_conflict"))


_SIGN_SQL = f"""SELECT *, concat('REFUSE|', coalesce(array_to_string(rf, ','), ''), '|', rf_state, '||false;RECYCLING|', coalesce(array_to_string(ry, ','), ''), '|', ry_state, '||false;ORGANICS|', coalesce(array_to_string(od, ','), ''), '|', og_state, '|', CASE WHEN og_state = 'POLICY_DERIVED' THEN '{vocab.ORGANICS_RULE}' ELSE '' END, '|', conflict) AS sign FROM ({_STATES_SQL})"""


@R.add(f"SELECT c_custkey, sign AS signature, concat('f', c_custkey, '~', substr(sha256(concat(c_nationkey, chr(10), sign)), 1, 16)) AS split_key FROM ({_SIGN_SQL})")
def q_schedule_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    s = s.select("c_custkey", "c_nationkey", T.signature({t: F.col(t) for t in ("REFUSE", "RECYCLING", "ORGANICS")}).alias("signature"))
    return s.select("c_custkey", "signature", T.split_key(F.concat(F.lit("f"), F.col("c_custkey")), F.col("c_nationkey").cast("string"), F.col("signature")).alias("split_key"))


@R.add(
    """SELECT p_partkey, trim(regexp_replace(concat('  ', p_name, chr(9), chr(10), p_brand, ' '), '\\s+', ' ', 'g')) AS clean, upper(p_type) AS code,
    CASE WHEN p_size % 10 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS ident,
    CASE WHEN p_size % 10 = 0 THEN 'true' ELSE 'false' END AS non_addressable,
    CASE WHEN p_partkey % 100 <> 0 THEN 'true' ELSE 'false' END AS usable,
    CASE p_size % 7 WHEN 1 THEN 'MANHATTAN' WHEN 2 THEN 'BRONX' WHEN 3 THEN 'BROOKLYN' WHEN 4 THEN 'QUEENS' WHEN 5 THEN 'STATEN ISLAND' END AS borough FROM part"""
)
def q_clean_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    number = F.when(F.col("p_size") % 10 == 0, F.lit(0.0)).otherwise(F.col("p_size").cast("double"))
    return p.select(
        "p_partkey", T.clean_text(F.concat(F.lit("  "), "p_name", F.lit("\t\n"), "p_brand", F.lit(" "))).alias("clean"), T.source_code(F.col("p_type")).alias("code"), T.clean_identifier(number).alias("ident"),
        T.is_non_addressable(number).cast("string").alias("non_addressable"), T.usable_address(F.concat(F.lit("No. "), (F.col("p_partkey") % 100).cast("string"))).cast("string").alias("usable"),
        T.borough_name(F.concat((F.col("p_size") % 7).cast("string"), F.lit(".9"))).alias("borough"),
    )


@R.add("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'F' THEN concat(' ', o_orderstatus) END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'none') AS first_value, coalesce(nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE o_orderpriority END), ''), CAST(o_orderkey AS VARCHAR)) AS origin FROM orders")
def q_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit(" "), "o_orderstatus")).otherwise("  ")
    priority = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", T.first_present(status, priority, F.lit("none")).alias("first_value"), F.coalesce(T.optional_text(F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(F.col("o_orderpriority"))), F.col("o_orderkey").cast("string")).alias("origin"))


@R.add(f"SELECT page_id, CASE WHEN regexp_full_match(v, '{vocab.VERSION_PATTERN[1:-1]}') THEN 'true' ELSE 'false' END AS is_version, CASE WHEN len(list_distinct(regexp_extract_all(v, '[0-9]+'))) = 1 THEN regexp_extract_all(v, '[0-9]+')[1] END AS release FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS v FROM pages)")
def q_version_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("v"))
    return v.select("page_id", T.is_version(F.col("v")).cast("string").alias("is_version"), T.unique_match(F.col("v"), "[0-9]+").alias("release"))


@R.add("SELECT c_custkey, CAST(2 + c_custkey % 3 AS BIGINT) AS n_points, CAST(c_custkey % 50 AS BIGINT) AS first_x, CAST(-(c_custkey % 7) AS BIGINT) AS first_y FROM customer WHERE c_custkey % 5 <> 0")
def q_parse_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = F.transform(F.sequence(F.lit(0), (k % 3 + 1).cast("int")), lambda i: F.concat_ws(" ", (k % 50 + i).cast("string"), (-(k % 7)).cast("string")))
    wkt = F.when(k % 5 == 0, F.concat(F.lit("POINT ("), points[0], F.lit(")"))).otherwise(F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")")))
    line = T.parse_wkt(wkt)[0]
    c = table(spark, sf_dir, "customer").select("c_custkey", line.alias("line")).where("line is not null")
    return c.select("c_custkey", F.size("line").cast("long").alias("n_points"), F.col("line")[0]["x"].cast("long").alias("first_x"), F.col("line")[0]["y"].cast("long").alias("first_y"))


@R.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'true' ELSE 'false' END AS is_integer, CASE WHEN json_exists(props, '$.absent') THEN 'true' ELSE 'false' END AS has_absent FROM events")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.json_whole(F.col("props"), "k").alias("k"), T.json_whole(F.col("props"), "k").isNotNull().cast("string").alias("is_integer"), T.json_has(F.col("props"), "absent").cast("string").alias("has_absent"))


_SCOPE = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' OR o_orderstatus = 'P' OR o_totalprice > 250000 THEN 'out_of_scope' WHEN o_totalprice < 20000 THEN 'invalid' ELSE 'matched' END"


@R.add(f"SELECT v.outcome, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES {', '.join(f'({chr(39)}{o}{chr(39)})' for o in vocab.SIDE_OUTCOMES)}) v(outcome) LEFT JOIN (SELECT {_SCOPE} AS outcome, count(*) AS n FROM orders GROUP BY 1) c ON v.outcome = c.outcome")
def q_scope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as source rows: types and states out of scope, vehicles only, missing segment ids; the rest goes on."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "B").when(F.col("o_orderpriority") == "2-HIGH", " g ").when(F.col("o_orderpriority") == "3-MEDIUM", "u").when(F.col("o_orderpriority") == "5-LOW", "E").otherwise("R")
    fixed = {c: F.lit("") for c in prepare.LINE_FIELDS} | {"SegmentTyp": kind, "FeatureTyp": F.lit(0.0), "Status": F.when(F.col("o_orderstatus") == "P", "3").otherwise("2.0"), "NonPed": F.when(F.col("o_totalprice") > 250000, "v"), "SegmentID": F.when(F.col("o_totalprice") < 20000, " ").otherwise(F.col("o_custkey").cast("string"))}
    point = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_row"), F.array(F.array(point, point)).alias("lines"), *(v.alias(c) for c, v in fixed.items()))
    found = prepare.row_outcomes(rows).select(F.coalesce("outcome", F.lit("matched")).alias("outcome"))
    return gates.outcome_counts(found, "outcome", vocab.SIDE_OUTCOMES)


@R.add("SELECT c_custkey FROM customer WHERE list_contains(string_split(coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'MON,THU' WHEN 'MACHINERY' THEN 'TUE' WHEN 'FURNITURE' THEN NULL ELSE 'THU' END, ''), ','), 'THU')")
def q_day_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_mktsegment")
    day_list = F.when(k == "BUILDING", "MON,THU").when(k == "MACHINERY", "TUE").when(k != "FURNITURE", "THU")
    return table(spark, sf_dir, "customer").where(serve.collects_on(day_list, "thu")).select("c_custkey")


@R.add("SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') > 365 THEN 'block' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') > 180 THEN 'warn' ELSE 'ok' END AS verdict FROM orders")
def q_policy_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date as the day of a policy's review."""
    return table(spark, sf_dir, "orders").select("o_orderkey", gates.policy_age(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("verdict"))


_POINT = {"component_length_feet": "l_extendedprice / 100", "best_distance_feet": "l_quantity * 2", "runner_up_distance_feet": "l_quantity * 2 + l_discount * 1000", "projection_from_start_feet": "l_extendedprice / 1000 + 5", "projection_from_end_feet": "l_tax * 1000"}


@R.add("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _POINT.items()) + """ FROM lineitem) WHERE l_returnflag <> 'R' AND l_linestatus = 'O' AND best_distance_feet <= 75
AND projection_from_start_feet >= least(20.0, component_length_feet * 0.1) AND projection_from_end_feet >= least(20.0, component_length_feet * 0.1) AND runner_up_distance_feet - best_distance_feet >= 25 AND runner_up_distance_feet >= best_distance_feet * 1.5 AND l_linenumber <= 3 GROUP BY 1""")
def q_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address-point evidence made of lines; missing evidence (a null flag) fails closed."""
    flags = dict.fromkeys(recovery.POINT_FLAGS, F.lit(True)) | {recovery.POINT_FLAGS[0]: F.when(F.col("l_returnflag") != "R", True), recovery.POINT_FLAGS[3]: F.col("l_linestatus") == "O"}
    rows = table(spark, sf_dir, "lineitem").selectExpr("*", *(f"{v} AS {k}" for k, v in _POINT.items())).select("*", *(v.alias(k) for k, v in flags.items()), F.when(F.col("l_linenumber") <= 3, 0).otherwise(1).alias("contradictory_point_count"))
    return rows.where(recovery.address_point_passes()).groupBy("l_orderkey").agg(F.count("*").alias("n"))


_GAP = {"endpoint_distance_feet": "l_discount * 5", "hausdorff_feet": "l_tax * 5", "length_ratio": "1.0 + (l_quantity - 25.0) / 1024", "projected_span_ratio": "1.0", "current_coverage_ratio": "1.0 - l_tax / 5", "uncovered_length_feet": "l_quantity / 10", "cscl_exact_coverage_ratio": "1.0"}


@R.add("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _GAP.items()) + """ FROM lineitem) WHERE l_returnflag <> 'R' AND l_linestatus <> 'F' AND endpoint_distance_feet <= 0.25 AND hausdorff_feet <= 0.25 AND length_ratio BETWEEN 0.99 AND 1.01
AND current_coverage_ratio >= 0.99 AND uncovered_length_feet <= 3 GROUP BY 1""")
def q_gap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of tiny gaps made of lines."""
    flags = dict.fromkeys(recovery.GAP_FLAGS, F.lit(True)) | {recovery.GAP_FLAGS[1]: F.when(F.col("l_returnflag") != "R", True), "different_signature_within_3_feet": F.col("l_linestatus") == "F", "schedule_signature_count": F.lit(1)}
    rows = table(spark, sf_dir, "lineitem").selectExpr("*", *(f"{v} AS {k}" for k, v in _GAP.items())).select("*", *(v.alias(k) for k, v in flags.items()))
    return rows.where(recovery.micro_gap_passes()).groupBy("l_orderkey").agg(F.count("*").alias("n"))


_CUSTOMER_STATES = f"SELECT c_custkey, unnest([{{'kind': 'REFUSE', 'state': rf_state}}, {{'kind': 'RECYCLING', 'state': ry_state}}, {{'kind': 'ORGANICS', 'state': og_state}}], recursive := true) FROM ({_STATES_SQL})"


@R.add(f"SELECT kind, CAST(sum(CASE WHEN state = 'SOURCE_EXPLICIT' THEN 1 ELSE 0 END) AS BIGINT) AS explicit, CAST(sum(CASE WHEN state = 'POLICY_DERIVED' THEN 1 ELSE 0 END) AS BIGINT) AS derived, CAST(sum(CASE WHEN state = 'UNKNOWN_SOURCE_BLANK' THEN 1 ELSE 0 END) AS BIGINT) AS blank, CAST(0 AS BIGINT) AS no_service FROM ({_CUSTOMER_STATES}) GROUP BY kind")
def q_state_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(t).alias("kind"), F.col(t)["state"].alias("state")) for t in ("REFUSE", "RECYCLING", "ORGANICS")))).alias("s")).select("s.*")
    wide = s.groupBy("kind").pivot("state", list(vocab.STATES)).agg(F.count(F.lit(1)))
    return wide.select("kind", *(F.coalesce(F.col(s), F.lit(0)).alias(n) for s, n in zip(vocab.STATES, ("explicit", "derived", "blank", "no_service"), strict=True)))


@R.add(f"SELECT rule, CAST(count(*) AS BIGINT) AS n, min(c_custkey) AS first_id FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN rf IS NULL THEN 'refuse_without_days' END, CASE WHEN conflict = 'true' THEN 'policy_conflict' END, CASE WHEN og_state = 'POLICY_DERIVED' AND ry_state <> 'SOURCE_EXPLICIT' THEN 'derived_without_source' END, CASE WHEN len(od) > 2 THEN 'too_many_days' END], lambda r: r IS NOT NULL)) AS rule FROM ({_STATES_SQL})) GROUP BY rule")
def q_state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    rules = {
        "refuse_without_days": F.size("REFUSE.days") == 0,
        "policy_conflict": F.col("ORGANICS.source_policy_conflict"),
        "derived_without_source": (F.col("ORGANICS.state") == vocab.DERIVED) & (F.col("RECYCLING.state") != vocab.EXPLICIT),
        "too_many_days": F.size("ORGANICS.days") > 2,
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return s.select("c_custkey", F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id"))


@R.add(f"""SELECT section, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'type' AS section, kind AS name, 1 AS n FROM ({_CUSTOMER_STATES}) UNION ALL SELECT 'state', state, 1 FROM ({_CUSTOMER_STATES}) UNION ALL SELECT 'reason', 'no_schedule', 1 FROM ({_STATES_SQL}) WHERE rf IS NULL AND ry IS NULL AND od IS NULL
UNION ALL SELECT 'type', unnest(['REFUSE', 'RECYCLING', 'ORGANICS', 'BULK']), 0 UNION ALL SELECT 'state', unnest(['SOURCE_EXPLICIT', 'POLICY_DERIVED', 'UNKNOWN_SOURCE_BLANK', 'NO_SERVICE']), 0) GROUP BY section, name""")
def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _states(spark, sf_dir)
    s = wide.select(F.explode(F.array(*(F.struct(F.lit(t).alias("collection_type"), F.col(t)["state"].alias("state")) for t in ("REFUSE", "RECYCLING", "ORGANICS")))).alias("s")).select("s.*")
    empty = wide.where((F.size("REFUSE.days") == 0) & (F.size("RECYCLING.days") == 0) & (F.size("ORGANICS.days") == 0)).select(F.lit("no_schedule").alias("reason_code"))
    return serve.health(s, s, empty)


#: Synthetic longitude and latitude of a customer, on exact eighths so both engines agree.
LON, LAT = "-74.5 + CAST(({k} * 37) % 1000 AS DOUBLE) / 1024.0", "40.25 + CAST(({k} * 91) % 800 AS DOUBLE) / 1024.0"
_STREETS_SQL = f"""WITH f AS (SELECT c_custkey, c_name, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat, {days_sql('r')} AS rf, {days_sql('y')} AS ry FROM (SELECT c_custkey, c_name, {raw('c_custkey')} AS r, {raw('(c_custkey // 8)')} AS y FROM customer)),
s AS (SELECT c_custkey, 'REFUSE' AS kind, unnest(rf) AS day FROM f UNION ALL SELECT c_custkey, 'RECYCLING', unnest(ry) FROM f),
d AS (SELECT c_custkey, kind, string_agg(DISTINCT day, ',' ORDER BY day) AS day_list FROM s GROUP BY ALL)
SELECT f.c_custkey AS face_id, f.c_name AS street, s.kind, d.day_list FROM s JOIN f USING (c_custkey) JOIN d ON d.c_custkey = s.c_custkey AND d.kind = s.kind
WHERE s.day = 'THU' AND s.kind IN ('REFUSE', 'RECYCLING') AND lon + 0.01 >= -74.25 AND lon <= -73.75 AND lat + 0.01 >= 40.5 AND lat <= 40.875"""


@R.add(_STREETS_SQL)
def q_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets with a collection of the wanted types on a day inside a box, with all days of that type."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr(LON.format(k="c_custkey")).alias("lon"), F.expr(LAT.format(k="c_custkey")).alias("lat"), T.days(F.expr(raw("c_custkey"))).alias("rf"), T.days(F.expr(raw("(c_custkey div 8)"))).alias("ry"))
    faces = c.select(F.col("c_custkey").alias("block_face_id"), F.col("c_name").alias("street_name"), F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), (F.col("lon") + 0.01).alias("max_x"), (F.col("lat") + 0.01).alias("max_y"))
    kinds = F.array(F.struct(F.lit("REFUSE").alias("kind"), F.col("rf").alias("d")), F.struct(F.lit("RECYCLING").alias("kind"), F.col("ry").alias("d")))
    schedules = c.select(F.col("c_custkey").alias("block_face_id"), F.explode(kinds).alias("s")).select("block_face_id", F.col("s.kind").alias("collection_type"), F.explode("s.d").alias("weekday"))
    found = serve.streets(faces, schedules, "THU", ("REFUSE", "RECYCLING"), (-74.25, 40.5, -73.75, 40.875))
    return found.select(F.col("block_face_id").alias("face_id"), F.col("street_name").alias("street"), F.col("collection_type").alias("kind"), F.array_join("weekdays", ",").alias("day_list"))
