"""Session factory: settings every plan of this library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "codeloom", master: str | None = None, partitions: int | None = None, **conf) -> SparkSession:
    """A session with AQE, UTC and Arrow on; master None leaves the cluster's own."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("CODELOOM_DRIVER_MEMORY", "16g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
