"""Session construction for scripts and tests. Operators never need it: they use the session of their input."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "basketwise", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are written for.

    The time zone is pinned so that period labels do not depend on the host, and skewed joins are
    split even where that costs one more exchange.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.checkpoint.compress": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
