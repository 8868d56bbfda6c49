"""Utilisation operators: running on-board load (W1), tap-side labels of
repeated stops (W7), vehicle-trip counts (A8, A9) and the utilisation
profile (M15).

Vehicle counts touch the full tap table. Labels come from small per-route
lookup tables that are broadcast (size-checked) into a single map-side pass
over the taps; the only shuffle on tap-sized data is one distinct over
(route, date, side, label, vehicle, trip), which is combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapflow.functions import tagged
from tapflow.model import ROUTE_KEY, SUFFIX_DESTINATION, SUFFIX_INTERMEDIATE, SUFFIX_ORIGIN
from tapflow.operators.common import merged_if_large, sized_broadcast
from tapflow.operators.od import od_counts, served_totals
from tapflow.operators.routes import route_summary, stop_labels, with_positions


def running_load(totals: DataFrame) -> DataFrame:
    """Passengers on board after each stop occurrence:
    ``load[0] = boardings[0]``, ``load[j] = load[j-1] + boardings[j] - alightings[j]``.
    Input: ``stop_totals`` (one row per stop occurrence, route-sized)."""
    w = (Window.partitionBy(*ROUTE_KEY).orderBy("seq")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = F.col("boardings") - F.when(F.col("pos") > 0, F.col("alightings")).otherwise(F.lit(0))
    return totals.withColumn("load", F.sum(step).over(w))


def _stop_lookup(routes: DataFrame) -> DataFrame:
    """Per (route, stop): first position, number of occurrences and the
    position of the second occurrence (null when served once). Route-sized,
    broadcast after a size check."""
    pos = with_positions(routes)
    return sized_broadcast(
        pos.groupBy(*ROUTE_KEY, "stop")
        .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("occ"),
             F.try_element_at(F.array_sort(F.collect_list("pos")), F.lit(2)).alias("second_pos")))


def tap_labels(taps: DataFrame, routes: DataFrame, occurrence: str = "odi") -> DataFrame:
    """The label of each tap's boarding and alighting stop.

    * ``terminal``: on a loop route, boarding at the first stop is ``_O`` and
      alighting at the last stop is ``_D``.
    * ``odi``: a stop served twice is ``_O`` when boarding and ``_D`` when
      alighting; a stop served three or more times takes its side from where
      the other end of the ride first appears on the route: boarding is
      ``_O`` when that position is at or before the stop's second
      occurrence, else ``_I``; alighting is ``_I`` at or before it, else
      ``_D``. When the other end is not on the route the label is null.
    * ``by_seq``: plain stop codes.
    Adds ``board_label`` and ``alight_label``.
    """
    src, dst = F.col("source"), F.col("destination")
    if occurrence == "by_seq":
        return taps.withColumn("board_label", src).withColumn("alight_label", dst)
    if occurrence == "terminal":
        loops = sized_broadcast(route_summary(routes).filter("is_loop")
                                .select(*ROUTE_KEY, F.col("first_stop").alias("_loop_stop")))
        out = taps.join(loops, list(ROUTE_KEY), "left")
        loop_stop = F.col("_loop_stop")
        return (out.withColumn("board_label", F.when(src == loop_stop, tagged(src, SUFFIX_ORIGIN)).otherwise(src))
                .withColumn("alight_label", F.when(dst == loop_stop, tagged(dst, SUFFIX_DESTINATION)).otherwise(dst))
                .drop("_loop_stop"))
    if occurrence != "odi":
        raise ValueError("occurrence must be by_seq, terminal or odi")
    lookup = _stop_lookup(routes)

    def end(prefix: str, stop_col: str) -> DataFrame:
        # one lookup per ride end: where that stop first appears, and its repeats
        return lookup.select(*ROUTE_KEY, F.col("stop").alias(stop_col),
                             F.col("first_pos").alias(f"{prefix}_first"),
                             F.when(F.col("occ") > 1, F.col("occ")).alias(f"{prefix}_occ"),
                             F.col("second_pos").alias(f"{prefix}_second"))

    # two broadcast joins, map-side: the rides are never shuffled here
    out = (taps.join(end("src", "source"), [*ROUTE_KEY, "source"], "left")
           .join(end("dst", "destination"), [*ROUTE_KEY, "destination"], "left"))

    def side(stop: Column, occ: Column, second: Column, other_first: Column,
             twice: str, early: str, late: str) -> Column:
        return (F.when(occ.isNull(), stop)
                .when(occ == 2, tagged(stop, twice))
                .when(other_first.isNull(), F.lit(None).cast("string"))
                .when(other_first <= second, tagged(stop, early))
                .otherwise(tagged(stop, late)))

    board = side(src, F.col("src_occ"), F.col("src_second"), F.col("dst_first"),
                 SUFFIX_ORIGIN, SUFFIX_ORIGIN, SUFFIX_INTERMEDIATE)
    alight = side(dst, F.col("dst_occ"), F.col("dst_second"), F.col("src_first"),
                  SUFFIX_DESTINATION, SUFFIX_INTERMEDIATE, SUFFIX_DESTINATION)
    return (out.withColumn("board_label", board).withColumn("alight_label", alight)
            .drop("src_occ", "src_second", "dst_occ", "dst_second", "dst_first", "src_first"))


def _distinct_vehicle_trips(labelled: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """Per (route, date, side, label): the number of distinct (vehicle, trip)
    rows. Distinct rows, not ``countDistinct``, so a null vehicle or trip
    still counts. Null labels (unplaced sides) are kept as their own group so
    the route key set stays complete; callers drop them. ``taps`` counts the
    rides behind each group."""
    # one pass: each ride yields one row per side (explode, not a union that
    # would evaluate the labelled rides twice)
    cols = {"board": "board_label", "alight": "alight_label"}
    sides_arr = F.array(*[F.struct(F.lit(sd).alias("side"), F.col(cols[sd]).alias("label")) for sd in sides])
    u = (labelled.select(*ROUTE_KEY, "date", "bus", "trip", F.explode(sides_arr).alias("_s"))
         .select(*ROUTE_KEY, "date", F.col("_s.side").alias("side"), F.col("_s.label").alias("label"),
                 "bus", "trip"))
    return (u.groupBy(*ROUTE_KEY, "date", "side", "label", "bus", "trip")
            .agg(F.count(F.lit(1)).alias("taps"))
            .groupBy(*ROUTE_KEY, "date", "side", "label")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("taps").alias("taps")))


def _label_map(per_label: DataFrame, value: str, *others: F.Column) -> DataFrame:
    """One row per route with rides: ``_m``, the map from label to ``value``
    (bounded by the route's stops), and further aggregates."""
    entry = F.when(F.col("label").isNotNull(), F.struct("label", value))
    return per_label.groupBy(*ROUTE_KEY).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"), *others)


def vehicle_trips_boarding(taps: DataFrame, routes: DataFrame, occurrence: str = "terminal") -> DataFrame:
    """Per stop occurrence of a route with taps, the sum over dates of
    distinct (vehicle, trip) boarding at its label. Stop occurrences sharing
    a label share the count. The rides are referenced once."""
    per_label = (_distinct_vehicle_trips(tap_labels(taps, routes, occurrence), ("board",))
                 .groupBy(*ROUTE_KEY, "label").agg(F.sum("n").alias("n")))
    return (merged_if_large(stop_labels(routes, occurrence)).join(_label_map(per_label, "n"), list(ROUTE_KEY))
            .withColumn("bus_count", F.coalesce(F.try_element_at("_m", F.col("label")), F.lit(0).cast("bigint")))
            .drop("_m"))


def vehicle_trips_mean(taps: DataFrame, routes: DataFrame, occurrence: str = "odi") -> DataFrame:
    """Per date and stop label the larger of distinct (vehicle, trip)
    boarding and alighting there, summed over dates, then averaged over all
    stop occurrences of the route (zeros included). One row per route with
    taps, with ``unplaced_taps``: taps whose repeated-stop side could not be
    placed because the other end of the ride is not on the route. The rides
    are referenced once."""
    per_day = _distinct_vehicle_trips(tap_labels(taps, routes, occurrence), ("board", "alight"))
    # A tap can lack a side label on one end only (a null boarding label
    # needs the alighting stop off the route and vice versa), so summing the
    # null-label groups of both sides counts each such tap once.
    per_label = (per_day.groupBy(*ROUTE_KEY, "date", "label").agg(F.max("n").alias("n"), F.sum("taps").alias("taps"))
                 .groupBy(*ROUTE_KEY, "label").agg(F.sum("n").alias("trips"), F.sum("taps").alias("taps")))
    maps = _label_map(per_label, "trips", F.sum(F.when(F.col("label").isNull(), F.col("taps")).otherwise(0))
                      .alias("unplaced_taps"))
    trips = F.coalesce(F.try_element_at("_m", F.col("label")), F.lit(0).cast("bigint"))
    return (merged_if_large(stop_labels(routes, occurrence)).join(maps, list(ROUTE_KEY)).groupBy(*ROUTE_KEY)
            .agg(F.avg(trips).alias("bus_count"), F.max("unplaced_taps").alias("unplaced_taps")))


def utilisation_profile(taps: DataFrame, routes: DataFrame, occurrence: str = "odi",
                        span: str = "per_seq_pair") -> DataFrame:
    """Per route with taps and per stop occurrence: label, 0-based
    position, boardings, alightings, running load and the route's mean
    vehicle-trip count (A9). The rides are referenced twice: for the O-D
    counts and for the vehicle trips."""
    totals = running_load(served_totals(od_counts(taps), routes, span))
    labels = merged_if_large(stop_labels(routes, occurrence).select(*ROUTE_KEY, "seq", "label"))
    buses = vehicle_trips_mean(taps, routes, occurrence).select(*ROUTE_KEY, "bus_count")
    return (totals.join(labels, [*ROUTE_KEY, "seq"])
            .join(buses, list(ROUTE_KEY), "left")
            .select(*ROUTE_KEY, "stop", "label", "pos", "seq", "boardings", "alightings",
                    "load", "bus_count"))
