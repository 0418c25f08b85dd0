"""Record digests, order-independent digests of tables, and snapshot comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(*columns: Column | str) -> Column:
    """Canonical JSON of columns: keys in order, nulls kept, no floats in it if the caller casts them."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def record_digest(*columns: Column | str) -> Column:
    return F.sha2(canonical(*columns), 256)


def aggregate_digest(df: DataFrame, id_: str, digest: str, buckets: int = 4096) -> DataFrame:
    """(n, digest) of a table of (id, digest), the same in any order of rows.

    Records are hashed together by bucket of their digest, then the buckets in order, so no task holds all of them.
    """
    record = F.concat(F.col(id_).cast("string"), F.lit("\0"), F.col(digest), F.lit("\n"))
    bucket = F.pmod(F.conv(F.substring(F.sha2(record, 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    parts = df.select(record.alias("r"), bucket.alias("b")).groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), ""), 256).alias("d"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("b", "d")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x["d"]), ""), 256).alias("digest"))


def diff(expected: DataFrame, actual: DataFrame, id_: str = "id", digest: str = "digest") -> DataFrame:
    """Rows (id, verdict) for ids that are missing, unexpected or mismatched."""
    a, b = expected.select(id_, F.col(digest).alias("a"), F.lit(True).alias("in_a")), actual.select(id_, F.col(digest).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, id_, "full_outer")
    verdict = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "mismatched")
    return both.select(id_, verdict.alias("verdict")).where("verdict is not null")
