"""Session settings for clusters and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "glossaspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps and adaptive plans; on a cluster the master, memory and shared
    folders come from its own configuration."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
