"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles, broadcasts a join side only when its
# measured size allows it, and splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Recording the Python call site of every expression costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(name: str = "orderloom") -> SparkSession.Builder:
    """A session builder with the library's settings; master and sizes are the caller's."""
    start = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        start = start.config(key, value)
    return start
