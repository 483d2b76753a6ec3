"""Session helper and the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .shipping import ship_package

# Adaptive execution picks join strategies from real sizes, splits skewed join
# partitions and coalesces small ones.  Nothing here pins a partition count.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(app: str = "jurispark", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session with the library's settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark
