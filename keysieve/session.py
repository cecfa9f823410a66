"""A local session for tests and timing; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_SETTINGS = {
    "spark.driver.memory": "8g",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("keysieve")
    for key, value in {**LOCAL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
