"""Session settings the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "figquarry", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, AQE on, last-wins maps; everything else is the cluster's. A present session is returned as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf).getOrCreate()
