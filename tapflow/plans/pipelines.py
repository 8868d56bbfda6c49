"""End-to-end workflows: read taps and routes, run the operators for every
service-direction in one plan, write the results.

* ``feature_extraction`` (E1): Bus rides on working days in a peak band ->
  O-D rows -> stop-series (v1) or distance-histogram (v2) features, split
  into strata by allow-lists.
* ``clustering`` (E2): DTW + Ward cuts for v1 features; k-means sweep with
  exact silhouettes and centred PCA for v2 features; output tree per k and
  cluster.
* ``utilisation`` (E3): utilisation profile per route and stop occurrence.
"""

from __future__ import annotations

from datetime import time
from typing import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapflow.model import AM_PEAK, WORKING_DAYS
from tapflow.operators import cluster as C
from tapflow.operators import distance as D
from tapflow.operators import features as FE
from tapflow.operators import graph as G
from tapflow.operators import load as L
from tapflow.operators import od as OD
from tapflow.operators import routes as R
from tapflow.operators import taps as T
from tapflow.operators.common import cut_lineage
from tapflow.sources import sinks


def prepared(taps: DataFrame, routes: DataFrame, valid_on: str, days: Iterable[str] | None = WORKING_DAYS,
             band: tuple[time, time] | None = AM_PEAK,
             period: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bus rides with a route key, optionally on ``days`` and touching
    ``band``; the routes valid on ``valid_on`` with positions. ``period``
    (first, last date) keeps the rides of those operational days; its range
    on the date column prunes a date-partitioned tap table at the scan."""
    if period:
        taps = T.within_dates(taps, *period)
    rides = T.with_route_key(T.bus_only(taps))
    if days:
        rides = T.in_days_of_week(rides, days)
    if band:
        rides = T.within_time_range(rides, *band)
    valid = R.with_positions(R.unique_occurrences(R.valid_for(routes, valid_on)))
    return rides, valid


def feature_extraction(taps: DataFrame, routes: DataFrame, valid_on: str, version: int = 2,
                       strata: Mapping[str, Iterable[str]] | None = None, out: str | None = None,
                       period: tuple[str, str] | None = None) -> DataFrame:
    """Features per service-direction (``feature`` array<double>), with
    a ``stratum`` column when allow-lists are given (rows of unlisted
    services are dropped). ``period`` as in ``prepared``."""
    rides, valid = prepared(taps, routes, valid_on, period=period)
    trips_df = OD.trips(rides, valid)
    feats = FE.stop_series(trips_df, valid) if version == 1 else FE.distance_histogram(trips_df, valid)
    if strata:
        feats = T.assign_stratum(feats, strata)
    if out:
        sinks.write_table(feats, out)
    return feats


def clustering(features: DataFrame, version: int = 2, ks: Iterable[int] | None = None,
               restarts: int = 3, max_iter: int = C.KMEANS_MAX_ITER, out: str | None = None,
               charts: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """E2 for one stratum. v1: exact DTW between stop series, Ward linkage,
    maxclust cuts (default k = 5..16). v2: k-means sweep (default k = 2..40,
    ``restarts`` seeds, all fits at once; a k above the number of items has
    null cost and silhouette) with exact silhouettes, and centred PCA to 3
    components. With ``out`` the labels and member features are written as a
    tree partitioned by k and cluster, together with each member route's
    chart nodes and edges when ``charts`` (from ``chart_tables``) is given
    (J9: label joined to features, O-D edges and route nodes)."""
    items = cut_lineage(FE.feature_vectors(features))
    result: dict[str, DataFrame] = {}
    if version == 1:
        merges = C.ward_linkage(D.pairwise(items, "item", "values", "dtw"))
        labels = C.cut_sweep(merges, ks or range(5, 17))
        result.update(merges=merges, gaps=C.merge_gaps(merges), labels=labels)
    else:
        result["sweep"], labels = C.kmeans_sweep(items, list(ks or range(2, 41)), restarts=restarts, max_iter=max_iter)
        result.update(labels=labels, pca=C.pca(items, 3))
    result["profile"] = C.cluster_profile(result["labels"], items)
    if out:
        tables = [("features", items.drop("features"))]
        if charts:
            keyed = [t.withColumn("item", F.concat_ws(":", "service", "direction")) for t in charts]
            tables += [("nodes", keyed[0]), ("edges", keyed[1])]
        sinks.write_cluster_tree(result["labels"], out, *tables)
    return result


def chart_tables(taps: DataFrame, routes: DataFrame, valid_on: str,
                 period: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Arc-diagram nodes (with degree) and edges for every route with rides;
    ``period`` as in ``prepared``, to count the rides that the features count."""
    rides, valid = prepared(taps, routes, valid_on, period=period)
    trips_df = OD.trips(rides, valid)
    edges = G.edges(trips_df)
    served = OD.routes_with_taps(trips_df, valid)
    return G.node_degree(G.nodes(served), edges), edges


def utilisation(taps: DataFrame, routes: DataFrame, valid_on: str, days: Iterable[str] | None = None,
                band: tuple[time, time] | None = None, occurrence: str = "odi",
                out: str | None = None, fmt: str = "parquet",
                period: tuple[str, str] | None = None) -> DataFrame:
    """Utilisation profile (label, position, totals, running load, mean
    vehicle trips) per route with rides; the day and band filters are
    optional (the reference defines but does not apply them)."""
    rides, valid = prepared(taps, routes, valid_on, days, band, period)
    profile = L.utilisation_profile(rides, valid, occurrence)
    if out:
        sinks.write_table(profile, out, fmt, partition_by=None)
    return profile


def run_from_files(spark: SparkSession, taps_path: str, routes_csv: str, valid_on: str, out: str) -> None:
    """Example driver: Parquet taps + route CSV -> v2 features and the
    utilisation profile under ``out``."""
    from tapflow.sources import readers
    taps = readers.read_taps_parquet(spark, taps_path)
    routes = readers.read_routes_csv(spark, routes_csv)
    feature_extraction(taps, routes, valid_on, 2, out=f"{out}/features_v2")
    utilisation(taps, routes, valid_on, out=f"{out}/utilisation")
