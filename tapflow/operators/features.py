"""Feature operators: top-k O-D pairs (W5, L4), stop series (M1), distance
histograms (W3, A10, M2) and vector assembly (M3, J8).

Features are built per service-direction from route-sized inputs (stop
totals), so the arrays collected per group are bounded by the route length
or the bin count, never by the number of taps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapflow.functions import divide_by_max, histogram_bin, l2_normalise
from tapflow.model import (HISTOGRAM_BINS, ROUTE_KEY, TOP_PAIRS_FRACTION_DIVISOR,
                           TOP_PAIRS_SMALL_K, TOP_PAIRS_THRESHOLD)
from tapflow.operators.od import pairs_per_route, stop_totals
from tapflow.operators.routes import normalise_km


def top_pairs(trips_df: DataFrame, threshold: int = TOP_PAIRS_THRESHOLD,
              divisor: int = TOP_PAIRS_FRACTION_DIVISOR, small_k: int = TOP_PAIRS_SMALL_K) -> DataFrame:
    """Per route keep the k busiest O-D rows, k = floor(n / 100) when the
    route has more than 300 O-D rows, else 3. Ties keep the earlier row in
    (source, destination, source_seq, destination_seq) order. Adds
    ``n_pairs`` (A15) and ``rank``."""
    w = Window.partitionBy(*ROUTE_KEY).orderBy(F.col("pax").desc(), "source", "destination",
                                                "source_seq", "destination_seq")
    k = F.when(F.col("n_pairs") > threshold, F.floor(F.col("n_pairs") / divisor)).otherwise(F.lit(small_k))
    return (pairs_per_route(trips_df)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def _ordered(col: str) -> F.Column:
    # Values of ``col`` in route order; bounded by the route length.
    return F.transform(F.array_sort(F.collect_list(F.struct("seq", col))), lambda s: s[col])


def stop_series(trips_df: DataFrame, routes: DataFrame) -> DataFrame:
    """M1: per route one array<double>: boardings by stop occurrence followed
    by alightings by stop occurrence, L2-normalised over the whole vector (a
    zero vector stays zero). Routes without O-D rows are skipped."""
    # every O-D row has pax >= 1, so a route has O-D rows exactly when its
    # boardings sum above zero: no second pass over the O-D rows for the keys
    totals = stop_totals(trips_df, routes)
    return (totals.groupBy(*ROUTE_KEY)
            .agg(_ordered("boardings").alias("_b"), _ordered("alightings").alias("_a"),
                 F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))),
                             lambda s: s["stop"]).alias("stops"),
                 F.sum("boardings").alias("_total"))
            .filter(F.col("_total") > 0)
            .select(*ROUTE_KEY, "stops",
                    l2_normalise(F.transform(F.concat("_b", "_a"), lambda x: x.cast("double")))
                    .alias("feature")))


def distance_histogram(trips_df: DataFrame, routes: DataFrame, bins: int = HISTOGRAM_BINS,
                       top: bool = True) -> DataFrame:
    """M2: per route one array<double> of 2 x ``bins``: the boarding totals,
    then the alighting totals, as weighted histograms over the stop distance
    normalised by the last stop's distance (W3, A10; range = [min, max] of the
    normalised distances, last bin closed). Each half is divided by its own
    maximum. With ``top`` the totals come from the top-k O-D rows (W5). A route
    with a stop whose normalised distance is missing has no feature
    (``routes.without_distance`` lists those); other routes are unaffected."""
    chosen = top_pairs(trips_df) if top else trips_df
    g = Window.partitionBy(*ROUTE_KEY)
    totals = (stop_totals(chosen, normalise_km(routes))
              .withColumn("_missing", F.count_if(F.col("km_norm").isNull()).over(g)).filter("_missing = 0")
              .withColumn("_lo", F.min("km_norm").over(g))
              .withColumn("_hi", F.max("km_norm").over(g)))
    binned = totals.withColumn("bin", histogram_bin(F.col("km_norm"), F.col("_lo"), F.col("_hi"), bins))
    hist = binned.groupBy(*ROUTE_KEY, "bin").agg(F.sum("boardings").cast("double").alias("b"),
                                                  F.sum("alightings").cast("double").alias("a"))

    def dense(col: str) -> F.Column:
        # zero-filled array over bins 0..bins-1 from the (bin -> value) entries
        m = F.map_from_entries(F.collect_list(F.struct("bin", col)))
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                           lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))

    # routes without chosen O-D rows have zero boardings everywhere: dropped
    return (hist.groupBy(*ROUTE_KEY)
            .agg(dense("b").alias("_b"), dense("a").alias("_a"), F.sum("b").alias("_total"))
            .filter(F.col("_total") > 0)
            .select(*ROUTE_KEY, F.concat(divide_by_max("_b"), divide_by_max("_a")).alias("feature")))


def long_form(features: DataFrame, col: str = "feature") -> DataFrame:
    """One row per (route, position) with the value at that position."""
    return features.select(*ROUTE_KEY, F.posexplode(col).alias("position", "value"))


def feature_vectors(features: DataFrame, col: str = "feature") -> DataFrame:
    """array<double> features as ML vectors, with an item id."""
    from pyspark.ml.functions import array_to_vector
    return features.select(*ROUTE_KEY, F.concat_ws(":", *ROUTE_KEY).alias("item"),
                           array_to_vector(col).alias("features"), F.col(col).alias("values"))
