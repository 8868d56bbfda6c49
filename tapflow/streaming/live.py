"""Streaming counterparts of the tap summaries.

The reference works on monthly batches only; these functions apply the same
O-D count (A1) and hourly tap count (A11) to a streaming tap source, with a
watermark on tap-in time so state for closed windows is dropped. The batch
operators' filters (``tapflow.operators.taps``) work unchanged on a
streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapflow.model import ROUTE_KEY


def stream_taps(spark, path: str, schema, fmt: str = "parquet", max_files_per_trigger: int | None = None):
    """Streaming tap source over a folder of files with a declared schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def _event_time(taps: DataFrame, watermark: str) -> DataFrame:
    # Watermarks need a session-zone TIMESTAMP; tap times may be TIMESTAMP_NTZ.
    return (taps.withColumn("event_time", F.col("tap_in").cast("timestamp"))
            .withWatermark("event_time", watermark))


def windowed_od_counts(taps: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """A1 per event-time window: rides per (window, service, direction,
    boarding stop, alighting stop); a window is final once the watermark
    (max tap-in seen minus ``watermark``) passes its end."""
    return (_event_time(taps, watermark)
            .groupBy(F.window("event_time", window).alias("window"), *ROUTE_KEY, "source", "destination")
            .agg(F.count(F.lit(1)).alias("pax"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    *ROUTE_KEY, "source", "destination", "pax"))


def hourly_taps(taps: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """A11 per event-time hour: rides per tap-in hour window."""
    return (_event_time(taps, watermark)
            .groupBy(F.window("event_time", "1 hour").alias("window"))
            .agg(F.count(F.lit(1)).alias("pax"))
            .select(F.col("window.start").alias("hour_start"), "pax"))
