"""The session that the engine expects: UTC, ANSI on, adaptive execution, Arrow for Python functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "ravine", **settings: str) -> SparkSession:
    """A session with SETTINGS; settings are added or replace them (dots as double underscores)."""
    own = {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=SETTINGS | own).getOrCreate()
