"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot sample ids and hot loci: AQE splits the skewed shuffle partitions.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Variants are sorted by position inside files, so footers prune well.
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "doseloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` uses ``__`` for the dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
