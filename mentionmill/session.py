"""Session set-up used by the tests, the bench and stand-alone jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app_name: str = "mentionmill", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
