"""Session settings for running the operators on a cluster.

The operators do not depend on any of these; they are the settings the plans
were designed around (AQE for partition coalescing and skew splitting,
partition sizes that fit executor memory, a shared checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Target bytes per shuffle partition and per input split.
PARTITION_BYTES = 256 * 1024 * 1024


def recommended_conf(shuffle_bytes: int | None = None, cores: int | None = None,
                     time_zone: str = "Asia/Singapore") -> dict[str, str]:
    """Spark settings for a large run. ``shuffle_bytes`` (largest shuffle,
    e.g. the per-day vehicle-trip distinct) sizes the initial shuffle
    partition count; AQE coalesces it down at run time. ``time_zone`` is that
    of the card readers: weekdays, bands and hours of timestamp columns follow
    the session's zone."""
    initial = max(cores or 200, (shuffle_bytes or 0) // PARTITION_BYTES + 1)
    return {
        "spark.sql.session.timeZone": time_zone,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }


def configure(builder: SparkSession.Builder, checkpoint_dir: str | None = None, **kw) -> SparkSession.Builder:
    """Apply ``recommended_conf`` to a builder; ``checkpoint_dir`` must be
    shared storage on a cluster (iterative operators write there)."""
    for k, v in recommended_conf(**kw).items():
        builder = builder.config(k, v)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder
