"""Relational checks and reports that the store, the validators and the serving queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of child whose column no parent's key has; a null is an orphan."""
    known = parent.select(F.col(key or column).alias(column)).distinct()
    return child.join(known, column, "left_anti")


def foreign_keys(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows (foreign_key, orphans): for each (name, child, column, parent, key) how many rows of child have no parent."""
    out = None
    for name, child, column, parent, key in links:
        part = orphans(child.select(column), column, parent, key).agg(F.count("*").alias("orphans")).select(F.lit(name).alias("foreign_key"), "orphans")
        out = part if out is None else out.union(part)
    return out


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, n) of keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def all_of_repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Every row whose keys another row has too, with n, the number of such rows. Only the repeated keys are joined back."""
    return df.join(repeated(df, *keys), list(keys))


def wrong_counts(df: DataFrame, key: str, wanted: int) -> DataFrame:
    """Rows (key, n) of keys that don't have just the wanted number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") != wanted)


def counts_by(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.groupBy(F.col(column).alias(name or column)).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, group: str, column: str) -> DataFrame:
    """Rows (group, n): distinct values of a column by group."""
    return df.select(group, column).distinct().where(F.col(column).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    """One row (n_groups): how many distinct keys there are."""
    return df.select(*keys).distinct().agg(F.count("*").alias("n_groups"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (n_overlap, passed) of the keys that both hold; two sets that must be apart pass with none."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return both.agg(F.count("*").alias("n_overlap")).select("n_overlap", (F.col("n_overlap") == 0).alias("passed"))


def compare_sets(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Rows (key, kind): missing in actual, unexpected there, or both."""
    a, b = expected.select(key, F.lit(True).alias("in_a")).distinct(), actual.select(key, F.lit(True).alias("in_b")).distinct()
    return a.join(b, key, "full_outer").select(key, F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").otherwise("both").alias("kind"))


def chain(df: DataFrame, key: str, steps: dict[str, DataFrame]) -> DataFrame:
    """Rows (key, missing) for keys of df that a step lacks: the name of the first such step. Each step's keys are looked up once."""
    out = df.select(key)
    for name, step in steps.items():
        out = out.join(step.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left")
    first = F.coalesce(*(F.when(F.col(f"has_{name}").isNull(), name) for name in steps))
    return out.select(key, first.alias("missing")).where("missing is not null")


def over_cap(df: DataFrame, cap: int) -> bool:
    """Whether a result has more rows than its cap, from one row beyond it."""
    return df.limit(cap + 1).count() > cap


def indexed(df: DataFrame, key: str, order: list[str], name: str = "component_index") -> DataFrame:
    """Adds each row's place from 0 among the rows of its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)


def newest(df: DataFrame, group: str, version: str, keep: int) -> DataFrame:
    """Rows (group, version, place) of the newest versions that are kept; each version counts once."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(version)))
    return df.select(group, version).distinct().withColumn("place", place.cast("long")).where(F.col("place") <= keep)


def first_by_text(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first n values in the order of their texts (10 comes before 9)."""
    return df.select(F.col(column).cast("string").alias(column)).orderBy(column).limit(n)


def sorted_list(values: Column | str) -> Column:
    """An aggregate: the distinct values, sorted."""
    return F.array_sort(F.collect_set(values))
