"""Tap-table operators: filters (P1-P4, P7-P9) and tap summaries (A6, A7,
A11, A12). Inputs use the logical names of ``TapColumns``."""

from __future__ import annotations

from datetime import time
from typing import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapflow.functions import in_band, operational_date, operational_weekday, weekday_numbers
from tapflow.model import AM_PEAK, ROUTE_KEY, WORKING_DAYS


def bus_only(taps: DataFrame, mode: str = "Bus") -> DataFrame:
    """Keep one travel mode; a plain equality, pushed into the Parquet scan."""
    return taps.filter(F.col("mode") == mode)


def with_route_key(taps: DataFrame, subset: Iterable[str] = ROUTE_KEY) -> DataFrame:
    """Drop rows whose service or direction is null."""
    return taps.dropna(subset=list(subset))


def in_days_of_week(taps: DataFrame, days: Iterable[str] = WORKING_DAYS,
                    time_col: str = "tap_in") -> DataFrame:
    """Keep rides on the given operational weekdays (a ride before 03:00
    counts for the previous day)."""
    return taps.filter(operational_weekday(time_col).isin(weekday_numbers(days)))


def within_time_range(taps: DataFrame, start: time | str = AM_PEAK[0],
                      end: time | str = AM_PEAK[1]) -> DataFrame:
    """Keep rides whose tap-in OR tap-out falls inside the inclusive band
    (whole seconds). A null tap-out leaves the decision to the tap-in."""
    return taps.filter(in_band("tap_in", start, end) | in_band("tap_out", start, end))


def within_dates(taps: DataFrame, first: str, last: str, slack_days: int = 1) -> DataFrame:
    """Rides of the operational days from ``first`` to ``last`` (a ride before
    03:00 belongs to the day before). A range on the partition column ``date``,
    wider by ``slack_days``, comes first, so a scan of date-partitioned taps
    prunes partitions."""
    first, last = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    near = F.col("date").between(F.date_sub(first, slack_days), F.date_add(last, slack_days))
    return taps.filter(near).filter(operational_date("tap_in").between(first, last))


def for_service(df: DataFrame, service: str, direction: int) -> DataFrame:
    """One service-direction (interactive use; batch plans group instead)."""
    return df.filter((F.col("service") == service) & (F.col("direction") == direction))


def allow_listed(df: DataFrame, services: Iterable[str], col: str = "service") -> DataFrame:
    """Keep services on an allow-list (the list is a parameter of fixed size)."""
    return df.filter(F.col(col).isin(list(services)))


def assign_stratum(df: DataFrame, strata: Mapping[str, Iterable[str]],
                   col: str = "service") -> DataFrame:
    """Label each row with the first stratum whose list holds its service;
    rows in no list are dropped (each analysis keeps only listed services)."""
    expr = None
    for name, services in strata.items():
        cond = F.col(col).isin(list(services))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn("stratum", expr).filter(F.col("stratum").isNotNull())


def service_directions(taps: DataFrame) -> DataFrame:
    """Distinct service-directions with a non-null key."""
    return with_route_key(taps.select(*ROUTE_KEY)).distinct()


def distinct_dates(taps: DataFrame) -> DataFrame:
    """Distinct ride dates."""
    return taps.select("date").distinct()


def taps_by_hour(taps: DataFrame) -> DataFrame:
    """Rides per tap-in hour, ordered by hour; a null hour forms its own
    group whose count is 0 (counting the hour, not the row)."""
    return (taps.select(F.hour("tap_in").alias("hr"))
            .groupBy("hr").agg(F.count("hr").alias("pax"))
            .orderBy("hr"))


def num_days(taps: DataFrame) -> DataFrame:
    """Number of distinct (year, day of year of tap-in), one row."""
    return (taps.select("year", F.dayofyear("tap_in").alias("day"))
            .distinct()
            .agg(F.count(F.lit(1)).alias("num_days")))


def bus_only_sql(taps: DataFrame, mode: str = "Bus") -> DataFrame:
    """The mode filter as a SQL statement over the DataFrame (no global
    temp view; the mode is a bound parameter)."""
    return taps.sparkSession.sql("SELECT * FROM {taps} WHERE mode = :mode",
                                 args={"mode": mode}, taps=taps)
