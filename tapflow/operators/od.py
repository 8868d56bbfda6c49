"""Origin-destination operators.

The tap table is aggregated to O-D counts first (A1: partial + final hash
aggregate, so a hot service is combined map-side); only that small result is
joined to the stop sequences of the routes, which are broadcast after a size
check. ``served_totals`` and ``served_matrix_rows`` take the O-D counts alone
and know from them which routes have rides, so a result scans the rides once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapflow.model import ROUTE_KEY
from tapflow.operators.common import sized_broadcast
from tapflow.operators.routes import with_positions
from tapflow.operators.taps import service_directions

SPANS = ("per_seq_pair", "per_od")


def od_counts(taps: DataFrame) -> DataFrame:
    """A1: rides per (service, direction, boarding stop, alighting stop)."""
    return (taps.groupBy(*ROUTE_KEY, "source", "destination")
            .agg(F.count(F.lit(1)).alias("pax")))


def _stop_seqs(routes: DataFrame) -> DataFrame:
    return sized_broadcast(routes.select(*ROUTE_KEY, "stop", "seq"))


def trips(taps: DataFrame, routes: DataFrame, span: str = "per_seq_pair") -> DataFrame:
    """O-D counts resolved onto the stop sequence of their route.

    A1 -> J1 (boarding stop -> ``source_seq``) -> J2 (alighting stop ->
    ``destination_seq``) -> P10 (forward spans only) -> A2.

    A stop served more than once fans out in J1/J2 (J3), so one O-D count can
    appear under several sequence pairs:

    * ``per_seq_pair`` keeps every forward (source_seq, destination_seq)
      combination (the reference's actual behaviour);
    * ``per_od`` keeps, per O-D pair, only the combination with the fewest
      stops travelled (ties: lower source_seq).
    """
    return resolve_trips(od_counts(taps), routes, span)


def resolve_trips(od: DataFrame, routes: DataFrame, span: str = "per_seq_pair") -> DataFrame:
    """J1, J2, P10 and A2 applied to O-D counts (see ``trips``)."""
    if span not in SPANS:
        raise ValueError(f"span must be one of {SPANS}")
    stops = _stop_seqs(routes)
    src = stops.select(*ROUTE_KEY, F.col("stop").alias("source"), F.col("seq").alias("source_seq"))
    dst = stops.select(*ROUTE_KEY, F.col("stop").alias("destination"),
                       F.col("seq").alias("destination_seq"))
    joined = (od.join(src, [*ROUTE_KEY, "source"])
              .join(dst, [*ROUTE_KEY, "destination"])
              .filter(F.col("destination_seq") - F.col("source_seq") > 0))
    if span == "per_od":
        w = (Window.partitionBy(*ROUTE_KEY, "source", "destination")
             .orderBy(F.col("destination_seq") - F.col("source_seq"), "source_seq"))
        joined = joined.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return joined.select(*ROUTE_KEY, "source", "destination", "source_seq", "destination_seq", "pax")


def pairs_per_route(trips_df: DataFrame) -> DataFrame:
    """Number of O-D rows of each service-direction, as a column."""
    return trips_df.withColumn("n_pairs", F.count(F.lit(1)).over(Window.partitionBy(*ROUTE_KEY)))


def pair_counts(trips_df: DataFrame) -> DataFrame:
    """A15 as one row for each service-direction."""
    return trips_df.groupBy(*ROUTE_KEY).agg(F.count(F.lit(1)).alias("n_pairs"))


def _resolved(od: DataFrame, routes: DataFrame, span: str) -> DataFrame:
    """O-D counts with their sequence pairs; O-D rows that resolve to no
    forward pair stay, with null sequences, so the set of service-directions
    that have rides is still in the result."""
    stops = _stop_seqs(routes)
    src = stops.select(*ROUTE_KEY, F.col("stop").alias("source"), F.col("seq").alias("source_seq"))
    dst = stops.select(*ROUTE_KEY, F.col("stop").alias("destination"), F.col("seq").alias("destination_seq"))
    joined = od.join(src, [*ROUTE_KEY, "source"], "left").join(dst, [*ROUTE_KEY, "destination"], "left")
    forward = F.coalesce(F.col("destination_seq") > F.col("source_seq"), F.lit(False))
    joined = joined.select(*ROUTE_KEY, "source", "destination", "pax",
                           F.when(forward, F.col("source_seq")).alias("source_seq"),
                           F.when(forward, F.col("destination_seq")).alias("destination_seq"))
    if span == "per_od":
        w = (Window.partitionBy(*ROUTE_KEY, "source", "destination")
             .orderBy((F.col("destination_seq") - F.col("source_seq")).asc_nulls_last(), "source_seq"))
        joined = joined.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return joined


def served_totals(od: DataFrame, routes: DataFrame, span: str = "per_seq_pair") -> DataFrame:
    """J5 + A4/A5: ``stop_totals`` of the routes that have rides, from the O-D
    counts, which are referenced once. The totals of a route travel as one
    map by sequence (bounded by the route's length); the join with the routes
    keeps those that have a map, an empty one included."""
    if span not in SPANS:
        raise ValueError(f"span must be one of {SPANS}")
    zero = F.lit(0).cast("bigint")
    ends = F.array(F.struct(F.col("source_seq").alias("seq"), F.col("pax").alias("b"), zero.alias("a")),
                   F.struct(F.col("destination_seq").alias("seq"), zero.alias("b"), F.col("pax").alias("a")))
    both = (_resolved(od, routes, span).select(*ROUTE_KEY, F.explode(ends).alias("_e")).select(*ROUTE_KEY, "_e.*")
            .groupBy(*ROUTE_KEY, "seq").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))
    entry = F.when(F.col("seq").isNotNull(), F.struct("seq", F.struct("b", "a")))
    maps = both.groupBy(*ROUTE_KEY).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    at = F.try_element_at("_m", F.col("seq"))
    return (with_positions(routes).join(maps, list(ROUTE_KEY))
            .withColumns({"boardings": F.coalesce(at["b"], zero), "alightings": F.coalesce(at["a"], zero)}).drop("_m"))


def served_matrix_rows(od: DataFrame, routes: DataFrame, span: str = "per_seq_pair") -> DataFrame:
    """J5 + J10/A3: ``od_matrix_rows`` of the routes that have rides, from the
    O-D counts, which are referenced once."""
    cells = (_resolved(od, routes, span).groupBy(*ROUTE_KEY, "source_seq", "destination_seq")
             .agg(F.sum("pax").alias("pax"))
             .groupBy(*ROUTE_KEY, F.col("source_seq").alias("seq"))
             .agg(F.collect_list(F.when(F.col("destination_seq").isNotNull(), F.struct("destination_seq", "pax"))).alias("to")))
    entry = F.when(F.col("seq").isNotNull(), F.struct("seq", F.map_from_entries("to")))
    maps = cells.groupBy(*ROUTE_KEY).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    zero = F.lit(0).cast("bigint")
    seqs = F.array_sort(F.collect_list("seq").over(Window.partitionBy(*ROUTE_KEY)))
    return (with_positions(routes).withColumn("_seqs", seqs).join(maps, list(ROUTE_KEY))
            .withColumn("_row", F.try_element_at("_m", F.col("seq")))
            .withColumn("pax_to", F.transform("_seqs", lambda s: F.coalesce(F.try_element_at(F.col("_row"), s), zero)))
            .withColumn("boardings", F.aggregate("pax_to", zero, lambda acc, x: acc + x))
            .drop("_seqs", "_m", "_row"))


def routes_with_taps(taps: DataFrame, routes: DataFrame) -> DataFrame:
    """J5 (semi): the route rows of service-directions that have taps. Pass
    an aggregate of the taps (e.g. ``od_counts``) rather than raw taps when
    one is at hand: the key set is the same and no extra tap scan is needed."""
    keys = taps.select(*ROUTE_KEY).dropna().distinct()
    return routes.join(keys, list(ROUTE_KEY), "left_semi")


def keys_without_route(taps: DataFrame, routes: DataFrame) -> DataFrame:
    """J5 (anti): service-directions seen in the taps but absent from the routes."""
    return service_directions(taps).join(routes.select(*ROUTE_KEY).distinct(),
                                         list(ROUTE_KEY), "left_anti")


def stop_totals(trips_df: DataFrame, routes: DataFrame) -> DataFrame:
    """A4/A5: boardings (row sums) and alightings (column sums) of the O-D
    matrix at every stop occurrence of the route, zero where nobody boards
    or alights. Adds ``pos`` (W2)."""
    zero = F.lit(0).cast("bigint")
    # one pass over the O-D rows: each yields its boarding and alighting end
    end_rows = F.array(F.struct(F.col("source_seq").alias("seq"), F.col("pax").alias("b"), zero.alias("a")),
                       F.struct(F.col("destination_seq").alias("seq"), zero.alias("b"), F.col("pax").alias("a")))
    ends = trips_df.select(*ROUTE_KEY, F.explode(end_rows).alias("_e")).select(*ROUTE_KEY, "_e.*")
    both = ends.groupBy(*ROUTE_KEY, "seq").agg(F.sum("b").alias("boardings"), F.sum("a").alias("alightings"))
    return (with_positions(routes)
            .join(both, [*ROUTE_KEY, "seq"], "left")
            .fillna(0, subset=["boardings", "alightings"]))


def od_matrix_rows(trips_df: DataFrame, routes: DataFrame) -> DataFrame:
    """The dense O-D matrix of each route, one row per origin stop
    occurrence: ``pax_to`` is an array<bigint> over the route's stop
    occurrences in sequence order, zero-filled. Rows, not pairs, are
    materialised, so the output has one row per stop occurrence."""
    cells = (trips_df.groupBy(*ROUTE_KEY, "source_seq", "destination_seq")
             .agg(F.sum("pax").alias("pax")))
    rows = (cells.groupBy(*ROUTE_KEY, F.col("source_seq").alias("seq"))
            .agg(F.map_from_entries(F.collect_list(F.struct("destination_seq", "pax"))).alias("_m")))
    seqs = F.array_sort(F.collect_list("seq").over(Window.partitionBy(*ROUTE_KEY)))
    return (with_positions(routes)
            .withColumn("_seqs", seqs)
            .join(rows, [*ROUTE_KEY, "seq"], "left")
            .withColumn("pax_to", F.transform(
                "_seqs", lambda s: F.coalesce(F.try_element_at(F.col("_m"), s), F.lit(0).cast("bigint"))))
            .withColumn("boardings", F.aggregate("pax_to", F.lit(0).cast("bigint"), lambda acc, x: acc + x))
            .drop("_seqs", "_m"))
