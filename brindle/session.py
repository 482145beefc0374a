"""Session with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors instead of silent overflow, one time zone, and plans that adapt to the sizes met at run time.
PROFILE = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.enableVectorizedReader": "true",
}


def local(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and the bench; a cluster's own session needs PROFILE alone."""
    build = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    build = build.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.showConsoleProgress", "false")
    return build.config(map=PROFILE).getOrCreate()
