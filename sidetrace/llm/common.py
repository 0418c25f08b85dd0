"""Helpers shared by the corpus operators: inputs, Arrow batch sizes, checkpoints, graph components.

Nothing here writes to a machine-local folder: lineage is cut with ``DataFrame.checkpoint`` in the
folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import json
import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows and bytes in one Arrow batch; texts may be very long, so bytes bind first.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

#: Rows up to which a side of (id, number) rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, makes this package importable in local workers, names a checkpoint folder if none is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    sc.environment.setdefault("PYTHONPATH", os.pathsep.join(x for x in (REPO, os.environ.get("PYTHONPATH", "")) if x))
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect garbage, so that shuffle files that nothing refers to go now and not when its heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed rows as one literal, which no Python worker has to make; schema is "name type, ..."."""
    names = [f.strip().split(" ", 1)[0] for f in re.split(r",(?![^<]*>)", schema)]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in re.split(r',(?![^<]*>)', schema))}>>")))


def within(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the narrow table df is within the checked size, else df as it is."""
    return F.broadcast(df) if within(df, rows) else df


def spare(name: str, columns: list[str]) -> str:
    """The name, or the first longer one by underscores, that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Joins batches sorted by ``keys`` into one table for each run of equal keys."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        columns = [part[k].to_pylist() for k in keys]
        at = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(at) + 1):
            if i < len(at) and at[i] == at[start]:
                continue
            if held and held_key != at[start]:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(start, i - start))
            held_key = at[start]
            if i < len(at):
                yield pa.concat_tables(held)
                held = []
            start = i
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and
    Beyond" (2014), as joins with map-side minima; each round is checkpointed and only counters reach the driver.
    Empty edges give no rows; loops, repeated and null edges are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("x"), "m", "a")
        e = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
