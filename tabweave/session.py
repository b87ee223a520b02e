"""Session builder with the settings every plan of this library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tabweave", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return a session in UTC with adaptive execution on.

    `shuffle_partitions` is left to the cluster's setting when None: adaptive execution coalesces what is too fine and
    splits what is skewed, so the value need only be large enough.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
