"""Reconciliation, regression and evidence gates over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidetrace import vocab


def outcome_counts(df: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Counts of every known outcome, zeros too; an unknown one raises when it is read."""
    every = df.sparkSession.createDataFrame([(o,) for o in known], f"{column} string")
    checked = df.select(F.when(F.col(column).isin(*known), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce(F.col(column), F.lit("null"))))).alias(column))
    return every.join(checked.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def reconciliation(population: str, expected: DataFrame, classified: DataFrame) -> DataFrame:
    """One row (population, expected, classified, difference, passed) from the row counts of both."""
    both = expected.select(F.lit(1).alias("e"), F.lit(0).alias("c")).union(classified.select(F.lit(0), F.lit(1)))
    counts = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("expected"), F.coalesce(F.sum("c"), F.lit(0)).alias("classified"))
    return counts.select(F.lit(population).alias("population"), "expected", "classified", (F.col("expected") - F.col("classified")).alias("difference"), (F.col("expected") == F.col("classified")).alias("passed"))


def regression(previous: DataFrame, current: DataFrame, floors: dict[str, int] | None = None, max_drop: float = vocab.MAX_DROP) -> DataFrame:
    """Rows (metric, previous, current, verdict): below its floor, dropped by more than the share allowed, or ok.

    Both inputs are (metric, n). A metric without a predecessor only has to reach its floor; one that is gone has dropped.
    """
    limits = F.create_map(*(F.lit(x) for kv in (floors or vocab.FLOORS).items() for x in kv))
    both = previous.select("metric", F.col("n").alias("previous")).join(current.select("metric", F.col("n").alias("current")), "metric", "full_outer")
    n = F.coalesce("current", F.lit(0))
    verdict = F.when(n < F.coalesce(F.try_element_at(limits, F.col("metric")), F.lit(0)), "below_floor").otherwise(drop_verdict(F.col("previous"), n, max_drop))
    return both.select("metric", "previous", n.alias("current"), verdict.alias("verdict"))


def drop_verdict(previous: Column, current: Column, max_drop: float = vocab.MAX_DROP) -> Column:
    """dropped if a count fell by more than the share allowed, else ok."""
    return F.when(current < previous * F.lit(1 - max_drop).cast("decimal(9,6)"), "dropped").otherwise("ok")


def deltas(df: DataFrame, group: str, version: str) -> DataFrame:
    """Rows (group, version, n, delta, verdict): each version's count beside that of the one before."""
    before = F.lag("n").over(Window.partitionBy(group).orderBy(version))
    seen = df.select(group, version, "n", before.alias("before"))
    return seen.select(group, version, "n", F.coalesce(F.col("n") - F.col("before"), F.lit(0)).alias("delta"), F.when(F.col("before").isNull(), "first").otherwise(drop_verdict(F.col("before"), F.col("n"))).alias("verdict"))


def size_gate(tiles: DataFrame, most: int = vocab.MAX_TILE_BYTES, most_raw: int = vocab.MAX_RAW_TILE_BYTES) -> DataFrame:
    """Tiles (z, x, y, data, raw_bytes) over a ceiling, which may be lowered but not raised."""
    if most > vocab.MAX_TILE_BYTES or most_raw > vocab.MAX_RAW_TILE_BYTES:
        raise ValueError("tile ceilings can only be lowered")
    return tiles.where((F.length("data") > most) | (F.col("raw_bytes") > most_raw)).select("z", "x", "y", F.length("data").alias("bytes"), "raw_bytes")


def policy_age(as_of: Column, reviewed: str | Column = vocab.POLICY_REVIEWED) -> Column:
    """ok, warn or block by the days since a policy's review."""
    age = F.datediff(as_of, reviewed if isinstance(reviewed, Column) else F.lit(reviewed).cast("date"))
    return F.when(age > vocab.POLICY_BLOCK_DAYS, "block").when(age > vocab.POLICY_WARN_DAYS, "warn").otherwise("ok")


def all_evidence(flags: dict[str, bool], limits: list[Column]) -> Column:
    """Whether every flag column has its wanted value and every limit holds; missing evidence fails."""
    out = F.lit(True)
    for name, wanted in flags.items():
        out &= F.coalesce(F.col(name) == wanted, F.lit(False))
    for limit in limits:
        out &= F.coalesce(limit, F.lit(False))
    return out


def clear_winner(best: Column, runner_up: Column, margin: float = 25.0, ratio: float = 1.5) -> Column:
    """Whether the runner-up is farther than the best by a margin and a ratio; without one there is nothing to beat."""
    return runner_up.isNull() | ((runner_up >= best + margin) & (runner_up >= best * ratio))


def endpoint_margin(position: Column, length: Column, feet: float = 20.0, share: float = 0.1) -> Column:
    """Whether a position keeps its distance from both ends of a line."""
    least = F.least(F.lit(feet), length * share)
    return (position >= least) & (position <= length - least)
