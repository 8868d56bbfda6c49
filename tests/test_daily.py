"""Daily counts: a month from its days, and days replaced one by one."""

from datetime import datetime

from frames import taps
from tapflow.operators import daily as DY
from tapflow.operators import od as OD


def rides(spark, days):
    out = None
    for day, n in days.items():
        part = taps(spark, [("a", "b", f"B{i % 2}", f"T{i % 3}") for i in range(n)], when=datetime(2024, 1, day, 8)) \
            .selectExpr("* except (date)", "to_date(tap_in) as date")
        out = part if out is None else out.unionByName(part)
    return out


def test_a_month_from_its_days_and_days_run_again(spark, tmp_dir):
    path, month = f"{tmp_dir}/daily", ("2024-01-01", "2024-01-31")
    t = rides(spark, {3: 5, 4: 2, 9: 7})
    DY.update_daily(t, path, ("2024-01-01", "2024-01-05"))
    DY.update_daily(t, path, ("2024-01-04", "2024-01-31"))
    want = {(r.source, r.destination, r.pax) for r in OD.od_counts(t).collect()}

    def month_od():
        return {(r.source, r.destination, r.pax) for r in DY.over_days(spark, path, "od", month).collect()}

    assert month_od() == want == {("a", "b", 14)}
    trips = DY.over_days(spark, path, "vehicle_trips", month).collect()
    assert [r.vehicle_trips for r in trips] == [5 + 2 + 6]  # distinct within a day, added up over days
    assert [(r.hour, r.rides) for r in DY.over_days(spark, path, "hours", month).collect()] == [(8, 14)]
    assert [(r.days, r.rides) for r in DY.service_days(spark, path, month).collect()] == [(3, 14)]
    # a corrected day replaces that day alone
    DY.update_daily(rides(spark, {4: 3, 9: 100}), path, ("2024-01-04", "2024-01-04"))
    assert month_od() == {("a", "b", 15)}
    assert [r.pax for r in DY.over_days(spark, path, "od", ("2024-01-04", "2024-01-08")).collect()] == [3]
    plan = DY.over_days(spark, path, "od", ("2024-01-04", "2024-01-04"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
