"""Interval and box overlap joins by grid cells: an equi-join on cells, an exact residual, and no shuffle to drop repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def interval_join(left: DataFrame, right: DataFrame, cell: float, lo: str = "lo", hi: str = "hi", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose closed intervals meet; columns of both sides get the prefixes l_ and r_.

    ``on`` names columns that must also be equal. Each interval is entered in all cells it touches; a pair is kept only in
    the larger of the two first cells, so it comes once. Rows with a null bound or lo > hi meet nothing.
    """
    sides = []
    for df, p in ((left, "l_"), (right, "r_")):
        ok = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi)))
        ok = ok.select(*(F.col(c).alias(p + c) for c in df.columns), _cell(F.col(lo), cell).alias(p + "_c0"), _cell(F.col(hi), cell).alias(p + "_c1"))
        sides.append(ok.withColumn("_cell", F.explode(F.sequence(p + "_c0", p + "_c1"))).drop(p + "_c1"))
    a, b = sides
    cond = (a["_cell"] == b["_cell"]) & (F.col(f"l_{lo}") <= F.col(f"r_{hi}")) & (F.col(f"r_{lo}") <= F.col(f"l_{hi}")) & (a["_cell"] == F.greatest("l__c0", "r__c0"))
    for c in on:
        cond &= F.col(f"l_{c}") == F.col(f"r_{c}")
    return a.join(b, cond).drop("_cell", "l__c0", "r__c0")


def box_join(left: DataFrame, right: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """Pairs of rows whose boxes (min_x, min_y, max_x, max_y), the left one padded, meet, edges included; prefixes l_ and r_.

    As interval_join, with the rule applied to each axis.
    """
    sides = []
    for df, p, grow in ((left, "l_", pad), (right, "r_", 0.0)):
        box = [F.col("min_x") - grow, F.col("min_y") - grow, F.col("max_x") + grow, F.col("max_y") + grow]
        out = df.where((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))
        out = out.select(*(F.col(c).alias(p + c) for c in df.columns), *(_cell(v, cell).alias(f"{p}_{n}") for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))
        out = out.withColumn("_cx", F.explode(F.sequence(f"{p}_x0", f"{p}_x1"))).withColumn("_cy", F.explode(F.sequence(f"{p}_y0", f"{p}_y1")))
        sides.append(out.drop(f"{p}_x1", f"{p}_y1"))
    a, b = sides
    meet = (F.col("l_max_x") + pad >= F.col("r_min_x")) & (F.col("l_min_x") - pad <= F.col("r_max_x")) & (F.col("l_max_y") + pad >= F.col("r_min_y")) & (F.col("l_min_y") - pad <= F.col("r_max_y"))
    once = (a["_cx"] == F.greatest("l__x0", "r__x0")) & (a["_cy"] == F.greatest("l__y0", "r__y0"))
    return a.join(b, (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"]) & meet & once).drop("_cx", "_cy", "l__x0", "l__y0", "r__x0", "r__y0")


def box_join_with_tolerance(left: DataFrame, right: DataFrame, cell: float, pad: float, key: str) -> DataFrame:
    """box_join, and for rows of left (named by key) that it leaves without a partner the padded one; used_tolerance tells which."""
    exact = box_join(left, right, cell)
    rest = left.join(exact.select(F.col(f"l_{key}").alias(key)).distinct(), key, "left_anti").select(*left.columns)
    return exact.withColumn("used_tolerance", F.lit(False)).unionByName(box_join(rest, right, max(cell, 2 * pad), pad).withColumn("used_tolerance", F.lit(True)))


def merged_intervals(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Union of closed intervals by key as disjoint ones, by a running maximum: rows (keys, lo, hi)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.where(f"{lo} is not null and {hi} is not null").withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    return starts.withColumn("_island", F.sum("_new").over(w)).groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")
