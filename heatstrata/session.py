"""Session settings for stand-alone use. A cluster's own session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("heatstrata")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", True)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", False)
        .getOrCreate()
    )
