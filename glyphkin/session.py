"""A Spark session with the settings that the library's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "glyphkin", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow. Settings given by name (dots as `__`) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
