"""Route-table operators (P5, P6, P15, W2-W4, W6, A13). A route table has one
row per stop occurrence: service, direction, stop, seq, km, dt_from, dt_to.
Routes are small (bounded by the network, not by the taps), so windows
partitioned by service-direction are cheap here."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapflow.functions import tagged
from tapflow.model import (MIN_ROUTE_KM, MIN_ROUTE_STOPS, ROUTE_KEY, SUFFIX_DESTINATION,
                           SUFFIX_INTERMEDIATE, SUFFIX_ORIGIN)

OCCURRENCE_MODES = ("by_seq", "terminal", "odi")


def _route_window() -> Window:
    return Window.partitionBy(*ROUTE_KEY)


def _ordered_window() -> Window:
    # stop and validity break ties of overlapping route versions
    return Window.partitionBy(*ROUTE_KEY).orderBy("seq", "dt_from", "stop", "km")


def valid_for(routes: DataFrame, when: date | datetime | str) -> DataFrame:
    """Rows whose inclusive validity range contains ``when``."""
    d = F.to_date(F.lit(str(when)[:10]))
    return routes.filter((F.col("dt_from") <= d) & (F.col("dt_to") >= d))


def unique_occurrences(routes: DataFrame) -> DataFrame:
    """Ingest check: exact duplicate rows collapse, so a repeated export line
    cannot double count. Rows that differ in anything are kept, also where
    versions overlap (``conflicting_occurrences`` lists those)."""
    return routes.dropDuplicates()


def conflicting_occurrences(routes: DataFrame) -> DataFrame:
    """Occurrences (service, direction, seq) with several different rows, and
    how many: overlapping versions of a route, or a faulty export."""
    return (unique_occurrences(routes).groupBy(*ROUTE_KEY, "seq").agg(F.count(F.lit(1)).alias("versions"))
            .filter("versions > 1"))


def with_positions(routes: DataFrame) -> DataFrame:
    """0-based position of each stop occurrence along its route (kept
    as is when the table already carries it)."""
    if "pos" in routes.columns:
        return routes
    return routes.withColumn("pos", F.row_number().over(_ordered_window()) - 1)


def normalise_km(routes: DataFrame) -> DataFrame:
    """Km divided by the km of the last stop (``km_norm``); null where km
    is null, or the last km is null or zero."""
    last_km = F.max_by("km", "seq").over(_route_window())
    return routes.withColumn("km_norm", F.try_divide(F.col("km"), last_km))


def without_distance(routes: DataFrame) -> DataFrame:
    """Routes that have no distance feature, with the number of stops whose
    normalised km is missing (a null km, or a last km of zero)."""
    return (normalise_km(routes).groupBy(*ROUTE_KEY)
            .agg(F.count_if(F.col("km_norm").isNull()).alias("missing")).filter("missing > 0"))


def route_summary(routes: DataFrame) -> DataFrame:
    """W6 and P15 inputs: per service-direction the stop count, route length
    (km of the last stop), first and last stop, and the loop test
    (first stop = last stop)."""
    return (routes.groupBy(*ROUTE_KEY)
            .agg(F.count(F.lit(1)).alias("n_stops"),
                 F.max_by("km", "seq").alias("route_km"),
                 F.min_by("stop", "seq").alias("first_stop"),
                 F.max_by("stop", "seq").alias("last_stop"))
            .withColumn("is_loop", F.col("first_stop") == F.col("last_stop")))


def long_enough(routes: DataFrame, min_km: float = MIN_ROUTE_KM,
                min_stops: int = MIN_ROUTE_STOPS) -> DataFrame:
    """Drop routes shorter than ``min_km`` AND with fewer than
    ``min_stops`` stops."""
    w = _route_window()
    n = F.count(F.lit(1)).over(w)
    km = F.max_by("km", "seq").over(w)
    return (routes.withColumn("_short", (km < min_km) & (n < min_stops))
            .filter(~F.col("_short")).drop("_short"))


def repeated_stops(routes: DataFrame) -> DataFrame:
    """Stops served more than once on a route, with their sorted
    sequence numbers (bounded by the route length)."""
    return (routes.groupBy(*ROUTE_KEY, "stop")
            .agg(F.sort_array(F.collect_list("seq")).alias("positions"))
            .withColumn("occurrences", F.size("positions"))
            .filter(F.col("occurrences") > 1))


def stop_labels(routes: DataFrame, occurrence: str = "odi") -> DataFrame:
    """Presentation label of each stop occurrence, plus ``pos``.

    * ``by_seq``: the plain stop code (results are keyed by sequence anyway).
    * ``terminal``: on a loop route (first stop = last stop) the first
      occurrence is tagged ``_O`` and the last ``_D``; nothing else changes.
    * ``odi``: any repeated stop: with two occurrences ``_O`` then ``_D``;
      with three or more ``_O``, ``_I``, ``_D`` for the first three (a fourth
      keeps the plain code).
    """
    if occurrence not in OCCURRENCE_MODES:
        raise ValueError(f"occurrence must be one of {OCCURRENCE_MODES}")
    out = with_positions(routes)
    stop = F.col("stop")
    if occurrence == "by_seq":
        return out.withColumn("label", stop)
    if occurrence == "terminal":
        w = _route_window()
        first = F.min_by("stop", "seq").over(w)
        last = F.max_by("stop", "seq").over(w)
        n = F.count(F.lit(1)).over(w)
        loop = first == last
        label = (F.when(loop & (F.col("pos") == 0), tagged(stop, SUFFIX_ORIGIN))
                 .when(loop & (F.col("pos") == n - 1), tagged(stop, SUFFIX_DESTINATION))
                 .otherwise(stop))
        return out.withColumn("label", label)
    ws = Window.partitionBy(*ROUTE_KEY, "stop")
    occ = F.row_number().over(ws.orderBy("seq"))
    cnt = F.count(F.lit(1)).over(ws)
    label = (F.when(cnt == 1, stop)
             .when(occ == 1, tagged(stop, SUFFIX_ORIGIN))
             .when((cnt == 2) & (occ == 2), tagged(stop, SUFFIX_DESTINATION))
             .when(occ == 2, tagged(stop, SUFFIX_INTERMEDIATE))
             .when(occ == 3, tagged(stop, SUFFIX_DESTINATION))
             .otherwise(stop))
    return out.withColumn("occurrence", occ).withColumn("occurrences", cnt).withColumn("label", label)
