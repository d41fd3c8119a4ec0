"""Session settings that the engine's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC and Arrow; on a cluster partitions are left to its own settings."""
    b = SparkSession.builder.appName("pairloom")
    if master:
        b = b.master(master)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        own["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=own | conf).getOrCreate()
