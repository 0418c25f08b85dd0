"""Spark sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sidetrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; what the cluster or the caller sets wins."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
