"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "wayscore", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
