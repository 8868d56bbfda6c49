"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables through the test binding (taps from
``events``, routes from ``part``) or reads ``embeddings`` directly, and runs
over the whole tables. Column names and types match ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapflow.model import RouteColumns, TapColumns
from tapflow.operators import cluster as C
from tapflow.operators import daily as DY
from tapflow.operators import distance as D
from tapflow.operators import features as FE
from tapflow.operators import graph as G
from tapflow.operators import load as L
from tapflow.operators import od as OD
from tapflow.operators import routes as R
from tapflow.operators import taps as T
from tapflow.operators import versions as V
from tapflow.operators.common import cut_lineage, head, round_doubles, shared_table, table_path
from tapflow.plans.oracle import STRATA, VALID_DATE
from tapflow.sources import fixtures
from tapflow.sources import readers
from tapflow.sources import sinks
from tapflow.sources.readers import clean_routes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(taps, routes) with logical names; routes valid on the analysis date,
    with positions (W2). Plans only: nothing is read, cached or remembered."""
    taps_raw, routes_raw = fixtures.load(spark, sf_dir)
    taps = TapColumns().standardise(taps_raw)
    routes = R.with_positions(R.unique_occurrences(R.valid_for(RouteColumns().standardise(routes_raw), VALID_DATE)))
    return taps, routes


def bus_taps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    taps, routes = inputs(spark, sf_dir)
    return T.with_route_key(T.bus_only(taps)), routes


def peak_taps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    taps, routes = bus_taps(spark, sf_dir)
    return T.within_time_range(T.in_days_of_week(taps)), routes


@register("running_load")
def running_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: running on-board load per service, direction and stop."""
    taps, routes = bus_taps(spark, sf_dir)
    totals = OD.served_totals(OD.od_counts(taps), routes)
    return (L.running_load(totals)
            .select("service", "direction", "stop", "pos", "seq", "boardings", "alightings", "load"))


def _text(c: str) -> F.Column:
    return F.col(c).cast("string").alias(c)


def _join_ints(c: str) -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


@register("bus_taps")
def bus_taps_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus rides with a route key, logical names
    (mode filter written in SQL over the DataFrame)."""
    taps, _ = inputs(spark, sf_dir)
    bus = T.with_route_key(T.bus_only_sql(taps))
    return round_doubles(bus.select("journey_id", "service", "direction", "source", "destination",
                                    "bus", "trip", "ride_km", "year", _text("date")))


@register("peak_taps")
def peak_taps_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working-day (03:00 rule) rides touching the AM peak band."""
    taps, _ = peak_taps(spark, sf_dir)
    from tapflow.functions import hms, operational_weekday
    return taps.select("journey_id", "service", "direction",
                       operational_weekday("tap_in").alias("op_weekday"),
                       hms("tap_in").alias("tap_in_hms"), hms("tap_out").alias("tap_out_hms"))


@register("service_directions")
def service_directions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct service-directions of the peak rides,
    kept when allow-listed, split into loop / non-loop strata, flagged when
    the route table has them (one left join to the distinct route keys)."""
    taps, routes = peak_taps(spark, sf_dir)
    keys = T.assign_stratum(T.allow_listed(T.service_directions(taps), STRATA["non_loop"] + STRATA["loop"]),
                            STRATA)
    known = routes.select("service", "direction").distinct().withColumn("known", F.lit(True))
    return (keys.join(known, ["service", "direction"], "left")
            .select("service", "direction", "stratum", F.col("known").isNotNull().alias("has_route")))


@register("distinct_dates")
def distinct_dates_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ride dates of the bus rides."""
    taps, _ = bus_taps(spark, sf_dir)
    return T.distinct_dates(taps).select(_text("date"))


@register("taps_by_hour")
def taps_by_hour_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides per tap-in hour."""
    taps, _ = bus_taps(spark, sf_dir)
    return T.taps_by_hour(taps)


@register("num_days")
def num_days_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (year, day of year) of the bus rides."""
    taps, _ = bus_taps(spark, sf_dir)
    return T.num_days(taps)


@register("routes_valid")
def routes_valid_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route rows valid on the analysis date, with positions."""
    _, routes = inputs(spark, sf_dir)
    return round_doubles(R.with_positions(routes)
                         .select("service", "direction", "stop", "seq", "pos", "km")
                         .orderBy("service", "direction", "seq"))


@register("route_summary")
def route_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop count, length, first/last stop, loop test and whether
    the route passes the length rule."""
    _, routes = inputs(spark, sf_dir)
    kept = R.long_enough(routes).select("service", "direction").distinct().withColumn("kept", F.lit(True))
    return round_doubles(R.route_summary(routes).join(kept, ["service", "direction"], "left")
                         .fillna(False, subset=["kept"]))


@register("repeated_stops")
def repeated_stops_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops served more than once per route, with their sequences."""
    _, routes = inputs(spark, sf_dir)
    return (R.repeated_stops(routes)
            .select("service", "direction", "stop", F.col("occurrences").cast("bigint").alias("occurrences"),
                    _join_ints("positions").alias("positions")))


@register("stop_labels")
def stop_labels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop labels under the terminal and odi rules."""
    _, routes = inputs(spark, sf_dir)
    term = R.stop_labels(routes, "terminal").select("service", "direction", "seq", "pos", "stop",
                                                    F.col("label").alias("label_terminal"))
    odi = R.stop_labels(routes, "odi").select("service", "direction", "seq",
                                              F.col("label").alias("label_odi"))
    return term.join(odi, ["service", "direction", "seq"])


@register("od_counts")
def od_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: rides per boarding and alighting stop of each service-direction."""
    taps, _ = bus_taps(spark, sf_dir)
    return OD.od_counts(taps)


@register("trips_per_seq_pair")
def trips_per_seq_pair_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 (J1, J2, J3, P10, A2 per sequence pair)."""
    taps, routes = bus_taps(spark, sf_dir)
    return OD.trips(taps, routes, "per_seq_pair")


@register("trips_per_od")
def trips_per_od_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 per O-D: the fewest-stops sequence pair of each O-D pair."""
    taps, routes = bus_taps(spark, sf_dir)
    return OD.trips(taps, routes, "per_od")


@register("pairs_per_route")
def pairs_per_route_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-D rows per service-direction."""
    taps, routes = bus_taps(spark, sf_dir)
    return OD.pair_counts(OD.trips(taps, routes))


@register("od_matrix")
def od_matrix_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense O-D matrix rows (zero-filled) per route with taps."""
    taps, routes = bus_taps(spark, sf_dir)
    return (OD.served_matrix_rows(OD.od_counts(taps), routes)
            .select("service", "direction", "seq", "pos", _join_ints("pax_to").alias("pax_to"), "boardings"))


@register("running_load_as_of")
def running_load_as_of_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 over a period: every ride on the route versions valid on its date;
    running load per version and stop."""
    taps, _ = bus_taps(spark, sf_dir)
    routes = R.unique_occurrences(RouteColumns().standardise(fixtures.route_versions(fixtures.table(spark, sf_dir, "part"))))
    counts = V.as_of(V.od_counts_by_date(taps), routes, ("2024-01-01", "2024-12-31"))
    load = L.running_load(OD.served_totals(counts, R.with_positions(V.versioned(routes))))
    return V.split_version(load).select("service", "direction", "version", "stop", "pos", "seq", "boardings", "alightings", "load")


@register("vehicle_trips_boarding")
def vehicle_trips_boarding_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 (terminal labels): distinct vehicle trips boarding per stop, summed over dates."""
    taps, routes = bus_taps(spark, sf_dir)
    return (L.vehicle_trips_boarding(taps, routes, "terminal")
            .select("service", "direction", "seq", "pos", "stop", "label", "bus_count"))


@register("vehicle_trips_mean")
def vehicle_trips_mean_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, W7 (odi labels): mean vehicle trips per route."""
    taps, routes = bus_taps(spark, sf_dir)
    return round_doubles(L.vehicle_trips_mean(taps, routes, "odi"))


@register("tap_sides")
def tap_sides_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides per (boarding label, alighting label) at repeated stops."""
    taps, routes = bus_taps(spark, sf_dir)
    labelled = L.tap_labels(taps, routes, "odi")
    changed = ((F.col("board_label") != F.col("source")) | (F.col("alight_label") != F.col("destination"))
               | F.col("board_label").isNull() | F.col("alight_label").isNull())
    return (labelled.filter(changed)
            .groupBy("service", "direction", "source", "destination", "board_label", "alight_label")
            .agg(F.count(F.lit(1)).alias("rides")))


@register("utilisation_profile")
def utilisation_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, position, totals, running load and mean vehicle trips."""
    taps, routes = bus_taps(spark, sf_dir)
    return round_doubles(L.utilisation_profile(taps, routes, "odi"))


@register("top_pairs")
def top_pairs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k busiest O-D rows per route (1 % above 300 rows, else 3)."""
    taps, routes = bus_taps(spark, sf_dir)
    return FE.top_pairs(OD.trips(taps, routes))


@register("stop_series")
def stop_series_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2-normalised boarding ++ alighting series, long form."""
    taps, routes = peak_taps(spark, sf_dir)
    return round_doubles(FE.long_form(FE.stop_series(OD.trips(taps, routes), routes))
                         .withColumnRenamed("value", "feature"))


@register("distance_histogram")
def distance_histogram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boarding ++ alighting histograms over normalised
    distance (10 bins each, each half divided by its maximum), long form."""
    taps, routes = peak_taps(spark, sf_dir)
    return round_doubles(FE.long_form(FE.distance_histogram(OD.trips(taps, routes), routes))
                         .withColumnRenamed("value", "feature"))


@register("chart_nodes")
def chart_nodes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc-diagram nodes with their degree."""
    taps, routes = peak_taps(spark, sf_dir)
    return round_doubles(G.served_node_degree(routes, OD.trips(taps, routes)))


@register("chart_edges")
def chart_edges_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc-diagram edges with scaled opacity and width."""
    taps, routes = peak_taps(spark, sf_dir)
    return round_doubles(G.edges(OD.trips(taps, routes)))


# ---------------------------------------------------------------- clustering
# Feature tables have one row per route; they are written once (cut_lineage)
# because the ML steps read them many times (fits, restarts, transforms).
def _series_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps, routes = bus_taps(spark, sf_dir)
    return cut_lineage(FE.feature_vectors(FE.stop_series(OD.trips(taps, routes), routes)))


def _histogram_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps, routes = peak_taps(spark, sf_dir)
    return cut_lineage(FE.feature_vectors(FE.distance_histogram(OD.trips(taps, routes), routes)))


def _embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("values"))


def _embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return cut_lineage(_embedding_points(spark, sf_dir).withColumn("features", array_to_vector("values")))


# The distances and the linkage of the stop series are read by several queries
# of a session, which share one table of each.
def _series_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(spark, ("dtw",), [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("events", "part")],
                        lambda: D.pairwise(_series_items(spark, sf_dir), "item", "values", "dtw"))


def _series_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(spark, ("ward",), [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("events", "part")],
                        lambda: C.ward_linkage(_series_pairs(spark, sf_dir)))


@register("dtw_distances")
def dtw_distances_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact DTW between the stop series of every pair of routes."""
    return round_doubles(_series_pairs(spark, sf_dir))


@register("dtw_banded")
def dtw_banded_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 with a warping band of 4 positions around the diagonal."""
    return round_doubles(D.pairwise(_series_items(spark, sf_dir), "item", "values", "dtw", band=4))


@register("dtw_nearest")
def dtw_nearest_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the nearest route of every route by DTW, found with lower bounds."""
    near = D.nearest(_series_items(spark, sf_dir), "item", "values")
    return round_doubles(near.select("id", "neighbour", "distance"))


@register("distance_matrix")
def distance_matrix_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the DTW matrix in long form (both orientations and the diagonal)."""
    return round_doubles(D.mirrored(_series_pairs(spark, sf_dir)))


@register("condensed_distances")
def condensed_distances_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the DTW distances as a condensed vector, with the items' numbers
    found again from the places."""
    pairs, items = D.condensed(_series_pairs(spark, sf_dir))
    n = items.select(F.count(F.lit(1))).scalar()
    return round_doubles(D.uncondensed(pairs, n).select("place", "i", "j", "distance"))


@register("ward_merges")
def ward_merges_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward linkage of the DTW distances, with height gaps."""
    merges = _series_linkage(spark, sf_dir)
    gaps = C.merge_gaps(merges)
    return round_doubles(merges.join(gaps.select("step", "gap", "suggested_k"), "step")
                         .select("step", "left", "right", "height", "size", "gap", "suggested_k"))


@register("ward_heights")
def ward_heights_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward merge heights and sizes in merge order, with the height
    gaps and the suggested number of clusters (cluster ids left out, so the
    result compares with a sequential implementation)."""
    return ward_merges_q(spark, sf_dir).select("step", "height", "size", "gap", "suggested_k")


@register("ward_embeddings")
def ward_embeddings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 from vectors: Ward linkage of the embeddings, no pair table."""
    return round_doubles(C.ward_from_vectors(_embedding_points(spark, sf_dir), "id", "values")
                         .select("step", "left", "right", "height", "size"))


@register("ward_clusters")
def ward_clusters_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: maxclust cuts for k = 5..16."""
    return C.cut_sweep(_series_linkage(spark, sf_dir), range(5, 17))


@register("ward_tied_cuts")
def ward_tied_cuts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 on tied heights: the embeddings on a coarse grid repeat, so cuts
    into nearly as many clusters as items give fewer."""
    points = _embedding_points(spark, sf_dir).select("id", F.transform(F.slice("values", 1, 2), lambda x: F.floor(x * 2) * 1.0)
                                                     .alias("values"))
    merges = shared_table(spark, ("ward_grid",), [f"{sf_dir.rstrip('/')}/embeddings.parquet"],
                          lambda: C.ward_from_vectors(points, "id", "values"))
    n = merges.count() + 1
    cuts = C.cut_sweep(merges, [n - n // 10, n - n // 4, n // 2])
    return cuts.groupBy("k").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("items"))


@register("ward_threshold_cuts")
def ward_threshold_cuts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: flat clusters below given heights."""
    return C.cut_heights(_series_linkage(spark, sf_dir), [0.5, 1.0, 2.0])


@register("cluster_charts")
def cluster_charts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward labels at k = 5 joined to the features, the O-D rows and the
    route stops of each member."""
    taps, routes = bus_taps(spark, sf_dir)
    tr = OD.trips(taps, routes)
    items = _series_items(spark, sf_dir)
    labels = C.cut(_series_linkage(spark, sf_dir), 5)
    stops = routes.select("service", "direction", "seq", "stop")
    return (labels.join(items.select("item", "service", "direction", F.size("values").alias("n_values")), "item")
            .join(tr, ["service", "direction"])
            .join(stops.withColumnRenamed("seq", "source_seq").withColumnRenamed("stop", "from_stop"),
                  ["service", "direction", "source_seq"])
            .join(stops.withColumnRenamed("seq", "destination_seq").withColumnRenamed("stop", "to_stop"),
                  ["service", "direction", "destination_seq"])
            .select("item", "cluster", "n_values", F.col("source_seq").alias("source"),
                    F.col("destination_seq").alias("target"), "from_stop", "to_stop", F.col("pax").alias("rides")))


@register("kmeans_sweep")
def kmeans_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, M9: per stratum, the least-cost k-means of 5 seeds and its exact
    silhouette for k = 2..40 over the distance-histogram features; cost and
    silhouette are null for a k above the stratum's items. All fits of both
    strata share their iterations."""
    items = cut_lineage(T.assign_stratum(_histogram_items(spark, sf_dir), STRATA))
    sweep, _ = C.kmeans_sweep(items, range(2, 41), restarts=5, group_col="stratum")
    sizes = items.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_items"))
    return round_doubles(sweep.join(sizes, "stratum").select("stratum", "k", "n_items", "cost", "silhouette"))


@register("cluster_profile")
def cluster_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means labels for k = 3 and the mean profile per cluster."""
    items = _histogram_items(spark, sf_dir)
    labels = C.kmeans_fits(items, [3], restarts=2).labels.select(F.col("id").alias("item"), "k", "cluster")
    return round_doubles(C.cluster_profile(labels, items))


@register("embedding_profile")
def embedding_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and mean vector of each given label of the embeddings."""
    items = _embedding_points(spark, sf_dir).withColumnRenamed("id", "item")
    labels = items.select("item", F.lit(0).alias("k"), F.col("label").alias("cluster"))
    return round_doubles(C.cluster_profile(labels, items))


@register("service_rides")
def service_rides_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rides of one service-direction."""
    taps, _ = bus_taps(spark, sf_dir)
    return T.for_service(taps, "S0", 1).select("journey_id", "source", "destination", "bus")


@register("service_route")
def service_route_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the route rows of one service-direction."""
    _, routes = inputs(spark, sf_dir)
    return round_doubles(T.for_service(routes, "S3", 2).select("stop", "seq", "km"))


@register("route_cleaning")
def route_cleaning_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route table as an export writes it (padded names, stop
    codes without leading zeros, dates as text), cleaned."""
    _, raw = fixtures.load(spark, sf_dir)
    text = raw.select(
        F.concat(F.lit("  "), "service", F.lit(" ")).alias("service"), F.col("direction").cast("string").alias("direction"),
        F.col("BusStopCode").cast("bigint").cast("string").alias("BusStopCode"),
        F.col("BusStopSequence").cast("string").alias("BusStopSequence"),
        F.coalesce(F.col("km").cast("string"), F.lit("n/a")).alias("km"),
        F.date_format("dt_from", "dd/MM/yyyy").alias("dt_from"),
        F.when(F.col("BusStopSequence") == 2, F.lit("31/02/2024")).otherwise(F.date_format("dt_to", "dd/MM/yyyy"))
        .alias("dt_to"))
    return round_doubles(clean_routes(text).withColumns({"dt_from": F.col("dt_from").cast("string"),
                                                         "dt_to": F.col("dt_to").cast("string")}))


def _exported_routes(spark: SparkSession, sf_dir: str) -> str:
    path = table_path(spark)
    fixtures.export_routes(fixtures.load(spark, sf_dir)[1], path)
    return path


@register("csv_folder_routes")
def csv_folder_routes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 on a folder: the route table written as CSV files of two layouts,
    some lines of them malformed, read by each file's header and cleaned."""
    rows = readers.read_routes_csv(spark, _exported_routes(spark, sf_dir))
    return round_doubles(rows.withColumns({"dt_from": F.col("dt_from").cast("string"), "dt_to": F.col("dt_to").cast("string")}))


@register("csv_rejects")
def csv_rejects_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a typed scan of that folder does not show, the malformed
    lines with their text and the rows with values that do not fit."""
    schema = spark.createDataFrame([], "service string, direction int, BusStopSequence bigint, km double").schema
    bad = readers.rejects(spark, _exported_routes(spark, sf_dir), schema)
    good = F.col(readers.MALFORMED).isNull()  # the columns of a malformed line are not certain
    return bad.select(F.col(readers.MALFORMED).alias("line"), F.when(good, F.concat_ws(",", "bad_columns")).alias("bad_columns"),
                      *[F.when(good, F.col(c)).alias(c.lower()) for c in schema.names])


@register("csv_folder_taps")
def csv_folder_taps_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, S5 on a folder: the rides written as CSV files of two layouts, read
    by each file's header with declared types, counted by day and hour."""
    path = table_path(spark)
    fixtures.export_taps(fixtures.load(spark, sf_dir)[0], path)
    rides = T.with_route_key(T.bus_only(readers.read_taps_csv(spark, path)))
    return round_doubles(rides.groupBy(_text("date"), "service", "direction", "source", F.hour("tap_out").alias("hour_out"))
                         .agg(F.count(F.lit(1)).alias("rides"), F.sum("ride_km").alias("km")))


JANUARY = ("2024-01-01", "2024-01-31")


def _daily(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The daily counts of January in two runs, of which the second repeats
    the days from the 11th to the 20th."""
    taps, _ = bus_taps(spark, sf_dir)
    path = table_path(spark)
    for period in (("2024-01-01", "2024-01-20"), ("2024-01-11", "2024-01-31")):
        DY.update_daily(taps, path, period, [name])
    return path


@register("daily_od_counts")
def daily_od_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, A1 by date: the O-D counts of the month from daily partitions."""
    return DY.over_days(spark, _daily(spark, sf_dir, "od"), "od", JANUARY)


@register("daily_vehicle_trips")
def daily_vehicle_trips_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, A8 by date: vehicle trips per boarding stop from daily partitions,
    for the days from the 6th to the 25th."""
    return DY.over_days(spark, _daily(spark, sf_dir, "vehicle_trips"), "vehicle_trips", ("2024-01-06", "2024-01-25"))


@register("daily_service_days")
def daily_service_days_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, A7, A12 by date: days with rides of every service-direction."""
    return DY.service_days(spark, _daily(spark, sf_dir, "od"), JANUARY)


@register("csv_round_trip")
def csv_round_trip_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route table written as one CSV file and as files by
    direction, read again with inferred types; rows as the first has them, and
    whether the second has them too."""
    _, routes = inputs(spark, sf_dir)
    rows = routes.select("service", "direction", "stop", "seq", "km")
    one, many = table_path(spark), table_path(spark)
    sinks.write_table(rows, one, "csv", single_file=True)
    sinks.write_table(rows, many, "csv", partition_by=["direction"])
    first = readers.read_csv_inferred(spark, one)
    second = spark.read.option("header", True).option("inferSchema", True).csv(many)
    key = ["service", "direction", "seq"]
    return round_doubles(first.join(second.select(*key, F.col("stop").alias("other")), key, "left")
                         .select("service", "direction", F.col("stop").cast("bigint").alias("stop"),
                                 F.col("seq").cast("bigint").alias("seq"), "km", (F.col("stop") == F.col("other")).alias("same")))


@register("cluster_tree")
def cluster_tree_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings written as a folder for each k and cluster
    (their labels, and those halved), read again and summed by folder."""
    points = sinks.persisted(_embedding_points(spark, sf_dir))
    labels = points.select(F.col("id").alias("item"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.floor(F.col("label").cast("int") / k).cast("int").alias("cluster")) for k in (1, 2)])).alias("c")) \
        .select("item", "c.*")
    path = table_path(spark)
    sinks.write_cluster_tree(labels, path, ("features", points.select(F.col("id").alias("item"), "values")))
    points.unpersist()
    back = spark.read.parquet(f"{path}/features")
    return round_doubles(back.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("items"),
                                                          F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total")))


@register("first_rides")
def first_rides_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the first 100 rides by time and number."""
    taps, _ = bus_taps(spark, sf_dir)
    return head(taps, 100, "tap_in", "journey_id").select("journey_id", "service", "direction", "source")


@register("pca_features")
def pca_features_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred PCA of the distance-histogram features to 3 components."""
    out = C.pca(_histogram_items(spark, sf_dir), 3)
    return round_doubles(out.select("service", "direction", *[F.col("pca")[i].alias(f"pc{i + 1}")
                                                              for i in range(3)]))


@register("silhouette_points")
def silhouette_points_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 exact: per-point silhouette of the embeddings under their labels."""
    return round_doubles(C.silhouette(_embedding_points(spark, sf_dir), "id", "label", "values"))


@register("silhouette_score")
def silhouette_score_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 exact: mean silhouette of the embeddings under their labels."""
    return round_doubles(C.silhouette_score(_embedding_points(spark, sf_dir), "id", "label", "values"))


@register("silhouette_squared")
def silhouette_squared_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9, fast mode: silhouettes of the embeddings by squared distances."""
    points = C.silhouette_by_squares(_embedding_points(spark, sf_dir), "label", "values")
    return round_doubles(points.select("id", "label", "a", "b", "silhouette"))


@register("kmeans_embeddings")
def kmeans_embeddings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 at larger n: k-means (k = 10, best of 5 seeds) over the embeddings."""
    return C.kmeans_fits(_embedding_points(spark, sf_dir), [10], restarts=5, id_col="id").labels.select("id", "cluster")


@register("kmeans_invariants")
def kmeans_invariants_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: what must hold for the converged k-means of the embeddings."""
    pts = _embedding_vectors(spark, sf_dir)
    model, _ = C.kmeans_best(pts, 10, restarts=1)
    return C.kmeans_invariants(pts, model)


@register("pca_embeddings")
def pca_embeddings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 at larger n: centred PCA of the embeddings to 3 components."""
    pts = _embedding_vectors(spark, sf_dir)
    return round_doubles(C.pca(pts, 3).select("id", *[F.col("pca")[i].alias(f"pc{i + 1}") for i in range(3)]))
