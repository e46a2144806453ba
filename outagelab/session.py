"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that matter for correctness (zone) and for scale (adaptive re-planning).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "outagelab", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

