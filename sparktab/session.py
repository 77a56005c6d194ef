"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "sparktab", **conf: str) -> SparkSession:
    """A session with this library's defaults; conf overrides them. The master is left to the environment."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()
