"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All timestamps are zone-less UTC, so the session zone is pinned; the adaptive
# settings let joins split hot partitions even when that costs another shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording the Python line of every column costs several gateway calls per column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "bizlake", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
