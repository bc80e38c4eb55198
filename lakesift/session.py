"""A session with the settings that the engine relies on; none of them is needed for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lakesift", **settings: str) -> SparkSession:
    """Adaptive plans (they split skewed joins and size partitions), UTC, and Arrow batches of bounded size."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
    builder = SparkSession.builder.appName(app)
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
