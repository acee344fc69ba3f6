"""Session settings for jobs that start their own session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Join keys follow the data: one map-lot or building may hold much of it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording a Python stack for every column slows down building plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Leave the number of shuffle partitions to the cluster; AQE merges small ones.
}


def session(app_name: str = "lotline", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
