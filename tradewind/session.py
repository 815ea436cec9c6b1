"""Session settings the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tradewind", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    Only ``master`` and ``shuffle_partitions`` are meant for local runs; on a cluster both come
    from the submit command and adaptive execution sizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("TRADEWIND_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
