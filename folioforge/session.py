"""Session defaults. Settings that the cluster already chose are never overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning does most of the sizing: partitions are coalesced after each shuffle, skewed
# join partitions are split, and a join side is broadcast only once its measured size allows it.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "folioforge", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the defaults above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
