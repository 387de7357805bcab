"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cores: int = 8, partitions: int | None = None, **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass the cluster's own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rivulet")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions or cores), "spark.driver.memory": "8g"} | settings
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
