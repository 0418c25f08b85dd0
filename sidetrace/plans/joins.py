"""Join, grouping, window, set and order queries: the library's operators on the driver's tables, mapped to their input schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sidetrace.operators import gates, ordering, prepare, rangejoin, sides, store
from sidetrace.operators import relate as O
from sidetrace.operators.digest import diff
from sidetrace.plans.base import Registry, table

R = Registry()


#: Lines as a store's schedule rows: an order is a face, a return flag its type, a line status its weekday.
def _schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_face_id"), F.col("l_returnflag").alias("collection_type"), F.col("l_linestatus").alias("weekday"))


@R.add("SELECT l_orderkey, l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS status_list, min(o_orderpriority) AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def q_inner_join_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = store.day_lists(_schedules(spark, sf_dir)).select(F.col("block_face_id").alias("l_orderkey"), F.col("collection_type").alias("l_returnflag"), F.array_join("weekdays", ",").alias("status_list"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return lists.join(o, "l_orderkey")


@R.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal <= c_acctbal + 100 AND s_acctbal + 500 >= c_acctbal)")
def q_semi_join_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 100).alias("hi"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 500).alias("hi"))
    return rangejoin.interval_join(c, s, 600.0, on=("k",)).select(F.col("l_c_custkey").alias("c_custkey")).distinct()


@R.add("SELECT 'order_without_line' AS rule, o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'line_without_order', l_orderkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL")
def q_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return O.orphans(o, "id", li).select(F.lit("order_without_line").alias("rule"), "id").union(O.orphans(li, "id", o).select(F.lit("line_without_order"), "id"))


@R.add("SELECT doc_id, CASE WHEN quality IS NULL THEN 'label' ELSE 'item' END AS missing FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id WHERE quality IS NULL OR item_id IS NULL")
def q_left_chain_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return O.chain(table(spark, sf_dir, "documents"), "doc_id", {"label": table(spark, sf_dir, "labels"), "item": items})


@R.add("SELECT CAST(count(*) AS BIGINT) AS n_overlap, CASE WHEN count(*) = 0 THEN 'true' ELSE 'false' END AS passed FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT CAST(count(*) AS BIGINT), CASE WHEN count(*) = 0 THEN 'true' ELSE 'false' END FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def q_empty_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents with toxic ones, and orders that have lines with those that have none."""
    la, o, li = table(spark, sf_dir, "labels"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    both = O.overlap(la.where("quality = 1"), la.where("toxic = 1"), "doc_id").union(O.overlap(li, O.orphans(o, "k", li), "k"))
    return both.select("n_overlap", F.col("passed").cast("string").alias("passed"))


_SNAP = "SELECT o_orderkey AS id, sha256(concat(o_custkey, '|', o_orderstatus, '|', o_orderpriority)) AS digest FROM orders WHERE o_orderpriority <> '5-LOW'"
_SNAP2 = "SELECT o_orderkey AS id, sha256(concat(o_custkey, '|', CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END, '|', o_orderpriority)) AS digest FROM orders WHERE o_orderpriority <> '1-URGENT'"


@R.add(f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unexpected' ELSE 'mismatched' END AS verdict FROM ({_SNAP}) a FULL OUTER JOIN ({_SNAP2}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.digest <> b.digest")
def q_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the orders: without one priority, and without another and with dear orders in another status."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus"))
    one = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus", "o_orderpriority"), 256).alias("digest"))
    two = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", "o_custkey", status, "o_orderpriority"), 256).alias("digest"))
    return diff(one, two)


_FKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]


@R.add(" UNION ALL ".join(f"SELECT '{a}.{x}' AS foreign_key, CAST(count(*) AS BIGINT) AS orphans FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b})" for a, x, b, y in _FKS))
def q_fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.foreign_keys([(f"{a}.{x}", table(spark, sf_dir, a), x, table(spark, sf_dir, b), y) for a, x, b, y in _FKS])


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as source rows: an order is a segment with one geometry, so its lines are aliases; they disagree on the right face id where return flags differ."""
    k = F.col("l_orderkey")
    fixed = {"SegmentTyp": "B", "FeatureTyp": "0", "Status": "2", "NonPed": "", "LBoro": "1", "RBoro": "2", "FromLeft": "0", "ToLeft": "0", "FromRight": "0", "ToRight": "0"}
    return table(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("source_row"), k.cast("string").alias("SegmentID"), F.concat(F.lit("L"), k).alias("LBlockFaceID"), F.concat(F.lit("R"), k, "l_returnflag").alias("RBlockFaceID"),
        F.concat(F.lit("STREET "), "l_suppkey").alias("Street"), F.when(F.col("l_discount") > 0.05, "X").alias("SpecAddr"), *(F.lit(v).alias(c) for c, v in fixed.items()),
        F.array(F.array(_point(k, F.lit(0)), _point(k + 100, F.lit(50)))).alias("lines"),
    )


_GROUPS = "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS f, arg_min(concat('STREET ', l_suppkey), (CASE WHEN l_discount > 0.05 THEN '1' ELSE '0' END || 'STREET ' || l_suppkey)) AS street, count(DISTINCT l_suppkey) AS streets FROM lineitem GROUP BY 1"


@R.add(f"SELECT CAST(l_orderkey AS VARCHAR) AS segment_id, street, CAST(n AS BIGINT) AS n_aliases, CAST(streets AS BIGINT) AS n_streets FROM ({_GROUPS}) WHERE f = 1")
def q_alias_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stands for each group of aliases: rows without the special mark first, then the smallest street."""
    canonical = prepare.segments(_segments(spark, sf_dir))[1]
    return canonical.select("segment_id", "street", F.size("source_rows").cast("long").alias("n_aliases"), F.size("street_names").cast("long").alias("n_streets"))


@R.add(f"SELECT CASE WHEN f > 1 THEN 'invalid' ELSE 'deduplicated_alias' END AS outcome, CASE WHEN f > 1 THEN 'aliases disagree on block-face ids' ELSE 'exact alias of another row' END AS reason, CAST(sum(CASE WHEN f > 1 THEN n ELSE n - 1 END) AS BIGINT) AS n FROM ({_GROUPS}) WHERE f > 1 OR n > 1 GROUP BY ALL")
def q_identity_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.segments(_segments(spark, sf_dir))[0].groupBy("outcome", "reason").agg(F.count("*").alias("n"))


_WARDS = "SELECT concat(n_regionkey, c_mktsegment) AS segment_id, CASE n_regionkey WHEN 0 THEN '1' WHEN 1 THEN '2.0' WHEN 2 THEN CASE WHEN c_acctbal > 0 THEN '3' ELSE '4' END WHEN 3 THEN '0' ELSE CASE WHEN c_acctbal > 9900 THEN 'x' ELSE '5' END END AS boro, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey"


@R.add(f"SELECT segment_id, CASE min(boro) WHEN '1' THEN 'MANHATTAN' WHEN '2.0' THEN 'BRONX' WHEN '3' THEN 'BROOKLYN' WHEN '4' THEN 'QUEENS' WHEN '5' THEN 'STATEN ISLAND' END AS borough, CASE WHEN bool_and(c_acctbal > -990) THEN 'true' ELSE 'false' END AS all_boundary, CASE WHEN bool_or(c_acctbal > 9000) THEN 'true' ELSE 'false' END AS any_range, CAST(count(*) AS BIGINT) AS n FROM ({_WARDS}) GROUP BY 1 HAVING count(DISTINCT boro) = 1 AND NOT bool_or(boro = 'x')")
def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the aliases of a segment agree on: one borough, all on a boundary, any with an address range."""
    n = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows
    boro = F.when(F.col("n_regionkey") == 0, "1").when(F.col("n_regionkey") == 1, "2.0").when(F.col("n_regionkey") == 2, F.when(F.col("c_acctbal") > 0, "3").otherwise("4")).when(F.col("n_regionkey") == 3, "0").otherwise(F.when(F.col("c_acctbal") > 9900, "x").otherwise("5"))
    fixed = {"SegmentTyp": "U", "FeatureTyp": "0", "Status": "2", "NonPed": "", "RBoro": "1", "LBlockFaceID": "L", "RBlockFaceID": "R", "Street": "A", "ToLeft": "0", "FromRight": "0", "ToRight": "0"}
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("source_row"), F.concat("n_regionkey", "c_mktsegment").alias("SegmentID"), boro.alias("LBoro"), F.when(F.col("c_acctbal") > -990, "9").otherwise("1").alias("LocStatus"),
        F.when(F.col("c_acctbal") > 9000, "12").otherwise("0").alias("FromLeft"), *(F.lit(v).alias(c) for c, v in fixed.items()), F.array(F.array(_point(F.lit(0), F.lit(0)), _point(F.lit(9), F.lit(9)))).alias("lines"),
    )
    c = prepare.segments(rows)[1]
    return c.select("segment_id", F.col("borough_LEFT").alias("borough"), F.col("all_boundary_LEFT").cast("string").alias("all_boundary"), F.col("any_range_LEFT").cast("string").alias("any_range"), F.size("source_rows").cast("long").alias("n"))


@R.add("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS parts FROM lineitem GROUP BY 1")
def q_collect_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_returnflag").alias("f"), F.array("l_partkey").alias("p"))
    return li.groupBy("l_orderkey").agg(F.array_join(sides.united("f"), ",").alias("flags"), F.array_join(sides.united("p").cast("array<string>"), ",").alias("parts"))


@R.add("SELECT 'merged' AS kind, l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS parts FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT (l_returnflag, l_linestatus)) = 1 UNION ALL SELECT 'conflict', l_orderkey, NULL FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def q_merge_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows of a key united if they agree, reported if they don't."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.array("l_partkey").alias("parts"))
    one, several = store.merge_repeated(li, "l_orderkey", ["l_returnflag", "l_linestatus"], ["parts"])
    return one.select(F.lit("merged").alias("kind"), "l_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts")).union(several.select(F.lit("conflict"), "l_orderkey", F.lit(None).cast("string")))


@R.add("WITH g AS (SELECT DISTINCT l_orderkey AS origin, l_returnflag AS area, l_linestatus AS signature FROM lineitem) SELECT origin, area, signature, CAST(count(*) OVER (PARTITION BY origin) AS BIGINT) AS n_parts, CASE WHEN count(*) OVER (PARTITION BY origin) > 1 THEN 'true' ELSE 'false' END AS is_split, CASE WHEN min(area) OVER (PARTITION BY origin) <> max(area) OVER (PARTITION BY origin) THEN 'true' ELSE 'false' END AS is_area_split FROM g")
def q_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("origin"), F.col("l_returnflag").alias("area"), F.col("l_linestatus").alias("signature")).distinct()
    marked = sides.split_marks(g, "origin", "area")
    return marked.select("origin", "area", "signature", "n_parts", F.col("is_split").cast("string").alias("is_split"), F.col("is_area_split").cast("string").alias("is_area_split"))


_FREQ = {"FREQ_REFUSE": ("p_type", "STANDARD ANODIZED TIN"), "FREQ_RECYCLING": ("p_brand", "Brand#13"), "FREQ_ORGANICS": ("p_brand", "Brand#22"), "FREQ_BULK": ("p_type", "PROMO BRUSHED STEEL")}


@R.add("SELECT field, CAST(count(*) AS BIGINT) AS blanks FROM (SELECT unnest([" + ", ".join(f"CASE WHEN {c} = '{v}' OR {c} IS NULL THEN '{f}' END" for f, (c, v) in _FREQ.items()) + "]) AS field FROM part) WHERE field IS NOT NULL GROUP BY field UNION ALL SELECT v.f, CAST(0 AS BIGINT) FROM (VALUES " + ", ".join(f"('{f}', (SELECT count(*) FROM part WHERE {c} = '{v}' OR {c} IS NULL))" for f, (c, v) in _FREQ.items()) + ") v(f, n) WHERE v.n = 0")
def q_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank schedule texts by field."""
    freq = table(spark, sf_dir, "part").select(*(F.when(F.col(c) != v, F.col(c)).otherwise("  ").alias(f) for f, (c, v) in _FREQ.items()))
    return prepare.blank_counts(freq)


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n AS BIGINT) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def q_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.all_of_repeated(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "l_linenumber")


@R.add("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def q_count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.counts_by(table(spark, sf_dir, "events"), "event_type")


@R.add("SELECT l_returnflag, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def q_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distinct_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey")


@R.add("SELECT CAST(count(*) AS BIGINT) AS n_groups FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)")
def q_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.group_count(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@R.add("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 4")
def q_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.wrong_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", 4)


_KINDS = {"click": "REFUSE", "view": "RECYCLING", "purchase": "ORGANICS", "error": "BULK"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END"
_DAY_SQL = "list_element(['MON', 'TUE', 'WED', 'THU', 'FRI', 'SAT'], CAST(isodow(ts) AS INT))"


def _day_list_sql(kind: str) -> str:
    return f"array_to_string(list_filter(['MON', 'TUE', 'WED', 'THU', 'FRI', 'SAT'], lambda d: list_contains(coalesce(list(d0) FILTER (k = '{kind}'), []), d)), ',') AS {kind.lower()}_days"


@R.add(f"SELECT block_face_id, {', '.join(_day_list_sql(k) for k in _KINDS.values())}, min(src) AS source, '2026' AS retrieved_at, CASE WHEN min(src) = max(src) THEN 'true' ELSE 'false' END AS single_source FROM (SELECT user_id AS block_face_id, {_KIND_SQL} AS k, {_DAY_SQL} AS d0, CASE WHEN value > 40 THEN 'b' ELSE 'a' END AS src FROM events) GROUP BY 1")
def q_pivot_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule rows turned into one row a face, with the check that they name one source."""
    kind = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))
    day = F.try_element_at(F.array(*(F.lit(d) for d in ("MON", "TUE", "WED", "THU", "FRI", "SAT"))), (F.weekday("ts") + 1))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("block_face_id"), F.try_element_at(kind, F.col("event_type")).alias("collection_type"), day.alias("weekday"), F.when(F.col("value") > 40, "b").otherwise("a").alias("source"), F.lit("2026").alias("retrieved_at"))
    return store.schedule_columns(e).withColumn("single_source", F.col("single_source").cast("string"))


@R.add("SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS BIGINT) AS component_index FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def q_component_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.indexed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct(), "l_orderkey", ["l_partkey"])


@R.add("SELECT batch, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(floor((row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) / 500) AS BIGINT) AS batch FROM orders) GROUP BY 1")
def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered text ids in batches of 500."""
    ids = ordering.numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id")), "id")
    return ids.withColumn("batch", F.floor(F.col("number") / 500)).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@R.add("SELECT event_type, version, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY version DESC) AS rn FROM (SELECT DISTINCT event_type, strftime(ts, '%Y%m%d') AS version FROM events)) WHERE rn <= 3")
def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.newest(table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyyMMdd").alias("version")), "event_type", "version", 3)


@R.add("WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before FROM d) SELECT event_type, day, n, coalesce(n - before, 0) AS delta, CASE WHEN before IS NULL THEN 'first' WHEN n * 10 < before * 9 THEN 'dropped' ELSE 'ok' END AS verdict FROM l")
def q_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return gates.deltas(d, "event_type", "day")


@R.add("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer ORDER BY 1 LIMIT 10")
def q_text_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_by_text(table(spark, sf_dir, "customer"), "c_custkey", 10)


@R.add("SELECT CAST(1000 AS BIGINT) AS cap, CASE WHEN count(*) > 1000 THEN 'true' ELSE 'false' END AS overflow FROM orders WHERE o_orderstatus = 'P'")
def q_cap_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a result is over its cap, from one row more than the cap."""
    over = O.over_cap(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), 1000)
    return spark.range(1).select(F.lit(1000).cast("long").alias("cap"), F.lit(str(over).lower()).alias("overflow"))


@R.add("SELECT k, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' ELSE 'both' END AS kind FROM (SELECT coalesce(a, b) AS k, a, b FROM (SELECT DISTINCT o_orderkey AS a FROM orders WHERE o_orderstatus <> 'P') FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem) ON a = b)")
def q_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return O.compare_sets(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


_STORE = """f AS (SELECT o_orderkey AS id, o_orderstatus FROM orders), s AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS flag, l_linestatus AS status FROM lineitem),
t AS (SELECT id, count(DISTINCT flag) AS types FROM s GROUP BY id)"""


@R.add(f"""WITH {_STORE} SELECT rule, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM (
SELECT 'face_without_states' AS rule, CAST(id AS VARCHAR) AS id FROM f WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT 'bad_side', CAST(id AS VARCHAR) FROM f WHERE o_orderstatus = 'P'
UNION ALL SELECT 'not_four_states', CAST(id AS VARCHAR) FROM t UNION ALL SELECT 'repeated_unknown', 'SEGMENT') GROUP BY rule""")
def q_store_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's rules on orders as faces and the kinds of their lines as states, with a repeated unknown face."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    faces = o.select(F.col("o_orderkey").alias("block_face_id"), F.when(F.col("o_orderstatus") == "P", "MIDDLE").otherwise("LEFT").alias("side"), *(F.lit(float(v)).alias(c) for c, v in (("min_x", 0), ("min_y", 0), ("max_x", 1), ("max_y", 1))))
    kind = F.when(F.col("l_returnflag") == "A", "REFUSE").when(F.col("l_returnflag") == "N", "RECYCLING").otherwise("BULK")
    states = li.select(F.col("l_orderkey").alias("block_face_id"), kind.alias("collection_type")).distinct().select("*", F.lit('["MON"]').alias("effective_days_json"), F.lit("SOURCE_EXPLICIT").alias("state"), F.lit(None).cast("string").alias("rule_id"))
    schedules = states.select("block_face_id", "collection_type", F.lit("MON").alias("weekday"))
    unknown = spark.range(2).select(F.lit("SEGMENT").alias("unknown_id"), F.lit(-1).cast("long").alias("technical_identity"))
    found = store.violations({"block_faces": faces, "collection_schedules": schedules, "block_face_collection_states": states, "unknown_block_faces": unknown})
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
