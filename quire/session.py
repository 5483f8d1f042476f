"""Session defaults for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quire", **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; further settings as keyword arguments (dots written as __)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
