"""Session defaults for jobs of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewell", master: str | None = None, **config: str) -> SparkSession:
    """UTC, adaptive execution; anything else can be given as ``spark_sql_...`` style keywords (``_`` stands for ``.``)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in config.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
