"""Rides on the route versions valid on their date."""

from datetime import date, datetime, timedelta

import pytest

from frames import taps
from tapflow.operators import versions as V

ROUTES = "service string, direction int, stop string, seq bigint, km double, dt_from date, dt_to date"


def version_rows(service, first, last, stops):
    return [(service, 1, s, i + 1, float(i), first, last) for i, s in enumerate(stops)]


@pytest.mark.parametrize("bucket_days", [1, 7, 32, 1000])
def test_rides_meet_the_versions_of_their_date(spark, bucket_days):
    d = lambda m, day: date(2024, m, day)
    rows = (version_rows("A", d(1, 1), d(2, 10), "abc") + version_rows("A", d(2, 11), date(9999, 12, 31), "axc")
            + version_rows("A", d(2, 20), d(2, 20), "ac") + version_rows("B@1", date(1900, 1, 1), d(3, 1), "ab")
            + version_rows("C", d(5, 1), d(4, 1), "ab") + version_rows("A", None, d(12, 31), "ac"))
    routes = spark.createDataFrame(rows, ROUTES)
    rides = []
    for service in ("A", "B@1", "C", "Z"):
        for day in range(0, 90, 5):
            when = datetime(2024, 1, 1, 8) + timedelta(days=day)
            rides.append(taps(spark, [("a", "c")] * (1 + day % 2), service=service, when=when).collect())
    t = spark.createDataFrame([r for part in rides for r in part], taps(spark, [("a", "c")]).schema)
    if "date" not in t.columns or t.filter("date <> to_date(tap_in)").count():
        t = t.selectExpr("* except (date)", "to_date(tap_in) as date")
    got = {(r.service, r.pax) for r in V.as_of(V.od_counts_by_date(t), routes, ("2024-01-01", "2024-12-31"), bucket_days).collect()}
    want = {}
    for service, first, last in {(r[0], r[5], r[6]) for r in rows if r[5] and r[6]}:
        for day in range(0, 90, 5):
            if first <= date(2024, 1, 1) + timedelta(days=day) <= last:
                key = f"{service}@{first}/{last}"
                want[key] = want.get(key, 0) + 1 + day % 2
    want.pop("Z", None)
    assert got == {(k, v) for k, v in want.items()}
    names = {(r.service, r.version) for r in V.split_version(V.versioned(routes)).collect()}
    assert ("B@1", "1900-01-01/2024-03-01") in names and ("A", "2024-02-11/9999-12-31") in names


def test_the_join_is_on_buckets_and_has_no_cross_join(spark):
    routes = spark.createDataFrame(version_rows("A", date(2024, 1, 1), date(9999, 12, 31), "ab"), ROUTES)
    plan = V.as_of(V.od_counts_by_date(taps(spark, [("a", "b")])), routes, ("2024-01-01", "2024-12-31"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in text and "HashJoin" in text or "SortMergeJoin" in text
    assert "Cartesian" not in text and "NestedLoop" not in text
    # the open end makes no buckets beyond the period
    laid = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in laid.lower()
