"""Plan shape (pushdown, pruning) and feature-vector properties on the
driver tables."""

import numpy as np
import pyspark.sql.functions as F

from conftest import SF_SMALL
from tapflow.operators import features as FE
from tapflow.operators import od as OD
from tapflow.operators import routes as R
from tapflow.operators import taps as T
from tapflow.plans import catalog
from tapflow.sources import fixtures, readers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mode_filter_and_pruning_reach_the_parquet_scan(spark, tmp_dir):
    taps_raw, _ = fixtures.load(spark, SF_SMALL)
    taps_raw.write.parquet(f"{tmp_dir}/taps")
    od = OD.od_counts(T.bus_only(readers.read_taps_parquet(spark, f"{tmp_dir}/taps")))
    plan = _plan(od)
    assert "EqualTo(TRAVEL_MODE,Bus)" in plan
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    for unused in ("tap_in_time", "Ride_Distance", "BUS_REG_NUM", "JOURNEY_ID"):
        assert unused not in scan


def test_route_lookups_are_broadcast(spark):
    taps, routes = catalog.bus_taps(spark, SF_SMALL)
    plan = _plan(OD.trips(taps, routes))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_one_scan_of_the_rides_for_each_result(spark):
    for name, scans in {"running_load": 1, "od_matrix": 1, "chart_nodes": 1, "service_directions": 1, "pairs_per_route": 1,
                        "vehicle_trips_boarding": 1, "vehicle_trips_mean": 1, "utilisation_profile": 2}.items():
        plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("event_id#") and sum("Relation [" in x and "event_id" in x for x in plan.splitlines()) == scans, name


def test_km_faults_leave_other_routes_unchanged(spark):
    from frames import route, taps as rides
    ok = route(spark, "A", 1, ["a", "b", "c"], [1.0, 2.0, 4.0])
    t = rides(spark, [("a", "c"), ("b", "c")])
    for kms, dropped in (([1.0, None, 4.0], True), ([0.0, 0.0, 0.0], True), ([1.0, 2.0, None], True), ([3.0, 3.0, 3.0], False)):
        both = ok.unionByName(route(spark, "B", 1, ["a", "b", "c"], kms))
        tt = t.unionByName(rides(spark, [("a", "c"), ("b", "c")], service="B"))
        got = {r.service: list(r.feature) for r in FE.distance_histogram(OD.trips(tt, both), both).collect()}
        alone = FE.distance_histogram(OD.trips(t, ok), ok).first().feature
        assert got["A"] == list(alone) and ("B" not in got) == dropped
        assert {r.service for r in R.without_distance(both).collect()} == ({"B"} if dropped else set())


def test_stop_series_unit_norm_and_histogram_halves(spark):
    taps, routes = catalog.peak_taps(spark, SF_SMALL)
    tr = OD.trips(taps, routes)
    for row in FE.stop_series(tr, routes).collect():
        v = np.array(row.feature)
        assert abs(np.linalg.norm(v) - 1.0) < 1e-12
        assert len(v) == 2 * len(row.stops)
    rows = FE.distance_histogram(tr, routes).collect()
    assert rows
    for row in rows:
        v = np.array(row.feature)
        assert len(v) == 20 and abs(v[:10].max() - 1.0) < 1e-12 and abs(v[10:].max() - 1.0) < 1e-12


def test_top_pairs_rule(spark):
    taps, routes = catalog.bus_taps(spark, "/root/testdata/sf0.01")
    tr = OD.trips(taps, routes)
    n = {(r.service, r.direction): r.n_pairs
         for r in OD.pairs_per_route(tr).select("service", "direction", "n_pairs").distinct().collect()}
    kept = {}
    for r in FE.top_pairs(tr).collect():
        kept[(r.service, r.direction)] = kept.get((r.service, r.direction), 0) + 1
    assert any(v > 300 for v in n.values())
    for key, cnt in n.items():
        assert kept[key] == (cnt // 100 if cnt > 300 else min(3, cnt))


def test_pipelines_from_files(spark, tmp_dir):
    from tapflow.plans import pipelines
    taps_raw, routes_raw = fixtures.load(spark, SF_SMALL)
    taps_raw.write.parquet(f"{tmp_dir}/taps")
    (routes_raw.select("service", "direction", "BusStopCode", "BusStopSequence", "km",
                       F.date_format("dt_from", "dd/MM/yyyy").alias("dt_from"),
                       F.date_format("dt_to", "dd/MM/yyyy").alias("dt_to"))
     .coalesce(1).write.option("header", True).csv(f"{tmp_dir}/routes"))
    pipelines.run_from_files(spark, f"{tmp_dir}/taps", f"{tmp_dir}/routes", "2024-01-15", f"{tmp_dir}/out")
    prof = spark.read.parquet(f"{tmp_dir}/out/utilisation")
    want = catalog.QUERIES["utilisation_profile"](spark, SF_SMALL)
    assert sorted(map(tuple, prof.drop("bus_count").collect())) == \
        sorted(map(tuple, want.select(*prof.drop("bus_count").columns).collect()))
    feats = spark.read.parquet(f"{tmp_dir}/out/features_v2")
    assert feats.count() == catalog.QUERIES["distance_histogram"](spark, SF_SMALL) \
        .select("service", "direction").distinct().count()
    res = pipelines.clustering(feats, version=2, ks=[2, 3], restarts=1, out=f"{tmp_dir}/tree")
    assert res["labels"].count() == 2 * feats.count()
    assert spark.read.parquet(f"{tmp_dir}/tree/features").count() == 2 * feats.count()


def test_date_partitions_are_pruned(spark, tmp_dir):
    from tapflow.plans import pipelines
    taps_raw, routes_raw = fixtures.load(spark, SF_SMALL)
    taps_raw.write.partitionBy("Date").parquet(f"{tmp_dir}/taps_by_date")
    from tapflow.model import RouteColumns
    taps = readers.read_taps_parquet(spark, f"{tmp_dir}/taps_by_date")
    routes = RouteColumns().standardise(routes_raw)
    rides, _ = pipelines.prepared(taps, routes, "2024-01-15", period=("2024-01-08", "2024-01-12"))
    plan = _plan(rides)
    assert "PartitionFilters: [isnotnull(Date" in plan and "Date#" in plan
    days = {r[0].isoformat() for r in rides.select(F.to_date(F.col("tap_in") - F.expr("interval 3 hours"))).distinct().collect()}
    assert days == {f"2024-01-{d:02d}" for d in range(8, 13)}
    every, _ = pipelines.prepared(taps, routes, "2024-01-15")
    day = F.to_date(F.col("tap_in") - F.expr("interval 3 hours"))
    assert rides.count() == every.filter(day.between("2024-01-08", "2024-01-12")).count()


def test_clustering_pipeline_v1(spark, tmp_dir):
    from tapflow.operators import graph as G
    from tapflow.plans import pipelines
    taps, routes = catalog.peak_taps(spark, "/root/testdata/sf0.01")
    tr = OD.trips(taps, routes)
    feats = FE.stop_series(tr, routes)
    charts = (G.node_degree(G.nodes(routes), G.edges(tr)), G.edges(tr))
    res = pipelines.clustering(feats, version=1, ks=[2, 3], out=f"{tmp_dir}/tree", charts=charts)
    assert spark.read.parquet(f"{tmp_dir}/tree/edges").count() == 2 * tr.count()
    n = feats.count()
    assert res["merges"].count() == n - 1
    labels = res["labels"].collect()
    assert len(labels) == 2 * n
    assert {r.k: len({x.cluster for x in labels if x.k == r.k}) for r in labels} == {2: 2, 3: 3}
    assert res["profile"].select("k", "cluster").distinct().count() == 5
