"""Counts kept by day (A1, A7, A8, A11, A12), so that a new day costs one day.

Every result here adds up over dates: rides per O-D pair, rides per hour, and
distinct vehicle trips per boarding stop, which the reference counts within a
date and sums over dates. ``update_daily`` computes them for the days of a
period and writes one partition a day, replacing the partitions of those days
alone (dynamic partition overwrite): running a day again changes nothing, and
other days are not read or written. ``over_days`` adds up any range of days
from the partitions that it prunes to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapflow.model import ROUTE_KEY
from tapflow.operators.versions import od_counts_by_date


def hours_by_date(taps: DataFrame) -> DataFrame:
    """A11 per date: rides per tap-in hour (a null hour counts 0, as in A11)."""
    hour = F.hour("tap_in")
    return taps.groupBy("date", hour.alias("hour")).agg(F.count(hour).alias("rides"))


def vehicle_trips_by_date(taps: DataFrame) -> DataFrame:
    """A8 per date: distinct (vehicle, trip) that a stop boards; a null
    vehicle or trip counts like a value."""
    return (taps.groupBy(*ROUTE_KEY, "date", F.col("source").alias("stop"))
            .agg(F.count_distinct(F.struct("bus", "trip")).alias("vehicle_trips")))


# What is kept: the daily table, and the column that adds up.
DAILY: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "od": (od_counts_by_date, "pax"), "hours": (hours_by_date, "rides"), "vehicle_trips": (vehicle_trips_by_date, "vehicle_trips")}


def update_daily(taps: DataFrame, path: str, period: tuple[str, str], names: Iterable[str] = tuple(DAILY)) -> None:
    """Compute and replace the days of ``period`` (first, last date) of the
    daily tables ``names``. The
    range on the date prunes a date-partitioned tap table at the scan. A day
    without rides keeps what it had, since no partition replaces it."""
    days = taps.filter(F.col("date").between(*[F.to_date(F.lit(d)) for d in period]))
    for name in names:
        (DAILY[name][0](days).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(f"{path.rstrip('/')}/{name}"))


def over_days(spark: SparkSession, path: str, name: str, period: tuple[str, str]) -> DataFrame:
    """The daily table ``name`` added up over the days of ``period``."""
    total = DAILY[name][1]
    days = spark.read.parquet(f"{path.rstrip('/')}/{name}").filter(F.col("date").between(*[F.to_date(F.lit(d)) for d in period]))
    keys = [c for c in days.columns if c not in ("date", total)]
    return days.groupBy(*keys).agg(F.sum(total).alias(total))


def service_days(spark: SparkSession, path: str, period: tuple[str, str]) -> DataFrame:
    """A7, A12 per service-direction: the days with rides, from the O-D days."""
    days = spark.read.parquet(f"{path.rstrip('/')}/od").filter(F.col("date").between(*[F.to_date(F.lit(d)) for d in period]))
    return days.groupBy(*ROUTE_KEY).agg(F.count_distinct("date").alias("days"), F.sum("pax").alias("rides"))
