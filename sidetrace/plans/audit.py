"""Digest, reconciliation and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidetrace.operators import digest as D
from sidetrace.operators import gates
from sidetrace.plans.base import Registry, table

R = Registry()


@R.add("""SELECT o_orderkey AS id, sha256(concat('{"o_orderkey":', o_orderkey, ',"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '","o_orderpriority":"', o_orderpriority, '"}')) AS digest FROM orders""")
def q_record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), D.record_digest("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("digest"))


@R.add(
    """WITH r AS (SELECT concat(o_orderkey, chr(0), sha256(concat(o_orderkey, '|', o_custkey)), chr(10)) AS r FROM orders),
    b AS (SELECT ('0x' || substr(sha256(r), 1, 8))::BIGINT % 4096 AS b, r FROM r),
    p AS (SELECT b, sha256(string_agg(r, '' ORDER BY r)) AS d, count(*) AS n FROM b GROUP BY b)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM p"""
)
def q_aggregate_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey"), 256).alias("d"))
    return D.aggregate_digest(o, "o_orderkey", "d")


@R.add(
    """SELECT 'rows' AS population, CAST((SELECT count(*) FROM orders) AS BIGINT) AS expected, CAST((SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')) AS BIGINT) AS classified
    UNION ALL SELECT 'sides', CAST((SELECT 2 * count(*) FROM orders) AS BIGINT), CAST((SELECT count(*) FROM orders, (VALUES ('LEFT'), ('RIGHT')) s(side) WHERE o_orderstatus IN ('O', 'F', 'P')) AS BIGINT)
    UNION ALL SELECT 'polygons', CAST((SELECT count(*) FROM customer) AS BIGINT), CAST((SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS BIGINT)"""
)
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    known = o.where(F.col("o_orderstatus").isin("O", "F", "P"))
    used = c.join(o.select(F.col("o_custkey").alias("k")), "k", "left_semi").select(F.lit(1).alias("u")).union(c.join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti").select(F.lit(0)))
    sides = known.select(F.explode(F.array(F.lit("LEFT"), F.lit("RIGHT"))).alias("side"))
    rows = gates.reconciliation("rows", o, known).union(gates.reconciliation("sides", o.select(F.explode(F.array(F.lit(1), F.lit(2)))), sides)).union(gates.reconciliation("polygons", c, used))
    return rows.select("population", "expected", "classified")


@R.add(
    """WITH a AS (SELECT o_orderstatus AS metric, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS metric, CAST(count(*) AS BIGINT) AS n FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') GROUP BY 1)
    SELECT b.metric, a.n AS previous, b.n AS current, CASE WHEN b.n < 1000 THEN 'below_floor' WHEN b.n * 10 < a.n * 9 THEN 'dropped' ELSE 'ok' END AS verdict FROM b JOIN a USING (metric)"""
)
def q_regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    count = lambda df: df.groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").alias("n"))
    floors = {s: 1000 for s in ("O", "F", "P")}
    return gates.regression(count(o), count(o.where("NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')")), floors)
