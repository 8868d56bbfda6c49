"""Route cleaning, validity, length rule and readers on hand-written files."""

from datetime import date

from frames import route
from tapflow.operators import routes as R
from tapflow.sources import readers


def test_route_csv_cleaning(spark, tmp_dir):
    path = f"{tmp_dir}/routes.csv"
    with open(path, "w") as f:
        f.write("service,direction,BusStopCode,BusStopSequence,km,dt_from,dt_to\n")
        f.write("  10 ,1,123,1,0.5,01/02/2017,28/02/2017\n")
        f.write("10,1,1234567,2,1.5,01/02/2017,28/02/2017\n")
        f.write("10,1,00042,3,bad,31/02/2017,28/02/2017\n")
    rows = readers.read_routes_csv(spark, path).orderBy("seq").collect()
    assert [r.service for r in rows] == ["10", "10", "10"]
    assert [r.stop for r in rows] == ["00123", "1234567", "00042"]
    assert rows[0].dt_from == date(2017, 2, 1) and rows[0].dt_to == date(2017, 2, 28)
    assert rows[2].km is None and rows[2].dt_from is None   # malformed values become null


def test_validity_overlap_and_length_rule(spark):
    a = route(spark, "A", 1, [f"s{i}" for i in range(10)], kms=[float(i) for i in range(10)])
    valid = R.valid_for(a, "2024-01-15")
    assert valid.count() == 10 and R.valid_for(a, "2024-02-01").count() == 0
    assert R.long_enough(a).count() == 0                  # 9 km and 10 stops: dropped
    long_a = route(spark, "B", 1, [f"s{i}" for i in range(10)], kms=[2.0 * i for i in range(10)])
    assert R.long_enough(long_a).count() == 10            # 18 km: kept


def test_route_summary_loop_and_repeats(spark):
    r = route(spark, "L", 1, ["p", "q", "p", "r", "p"])
    s = R.route_summary(r).first()
    assert s.is_loop and s.n_stops == 5 and s.first_stop == "p"
    rep = R.repeated_stops(r).first()
    assert rep.stop == "p" and list(rep.positions) == [1, 3, 5]


def test_tap_csv_declared_schema_and_rejects(spark, tmp_dir):
    path = f"{tmp_dir}/taps.csv"
    header = ("ALIGHTING_STOP_STN,BOARDING_STOP_STN,BUS_REG_NUM,Bus_Trip_Num,Direction,JOURNEY_ID,"
              "Ride_Distance,TRAVEL_MODE,Year,tap_in_time,tap_out_time,Srvc_Number,Date\n")
    with open(path, "w") as f:
        f.write(header)
        f.write("00002,00001,B1,1,1,10,2.5,Bus,2017,2017-02-01 08:00:00,2017-02-01 08:20:00,10,2017-02-01\n")
        f.write("00002,00001,B1,1,x,11,2.5,Bus,2017,2017-02-01 08:00:00,,10,2017-02-01\n")
    t = readers.read_taps_csv(spark, path)
    assert t.columns[:3] == ["source", "destination", "year"]
    rows = t.orderBy("journey_id").collect()
    assert rows[0].direction == 1 and rows[1].direction is None and rows[1].tap_out is None
    assert readers.rejects(spark, path).count() == 1


def test_csv_columns_are_read_by_name(spark, tmp_dir):
    import pytest
    with open(f"{tmp_dir}/routes.csv", "w") as f:
        f.write("direction,service,note,BusStopSequence,BusStopCode,dt_to,dt_from,km\n")
        f.write("1,10,x,2,7,28/02/2017,01/02/2017,1.5\n")
    r = readers.read_routes_csv(spark, f"{tmp_dir}/routes.csv").first()
    assert (r.service, r.direction, r.stop, r.seq, r.km) == ("10", 1, "00007", 2, 1.5)
    with open(f"{tmp_dir}/taps.csv", "w") as f:
        f.write("JOURNEY_ID,Srvc_Number,Direction,extra,TRAVEL_MODE,Year,tap_in_time,tap_out_time,Date,Ride_Distance,"
                "BUS_REG_NUM,Bus_Trip_Num,BOARDING_STOP_STN,ALIGHTING_STOP_STN\n")
        f.write("5,S1,2,?,Bus,2017,2017-02-01 08:00:00,,2017-02-01,2.5,B1,4,00001,00002\n")
        f.write("6,S1,two,?,Bus,2017,never,,2017-02-01,2.5,B1,4,00001,00002\n")
    rows = readers.read_taps_csv(spark, f"{tmp_dir}/taps.csv").orderBy("journey_id").collect()
    assert (rows[0].service, rows[0].direction, rows[0].mode, rows[0].source, rows[0].destination) == ("S1", 2, "Bus", "00001", "00002")
    assert rows[1].direction is None and rows[1].tap_in is None
    bad = readers.rejects(spark, f"{tmp_dir}/taps.csv").collect()
    assert [(r.JOURNEY_ID, sorted(r.bad_columns)) for r in bad] == [("6", ["Direction", "tap_in_time"])]
    with open(f"{tmp_dir}/short.csv", "w") as f:
        f.write("service,direction\n1,1\n")
    with pytest.raises(ValueError):
        readers.read_routes_csv(spark, f"{tmp_dir}/short.csv")


def test_inferred_csv(spark, tmp_dir):
    with open(f"{tmp_dir}/m.csv", "w") as f:
        f.write("a,b\n1,2.5\n3,x\n")
    df = readers.read_csv_inferred(spark, f"{tmp_dir}/m.csv")
    assert df.dtypes == [("a", "int"), ("b", "string")] and df.count() == 2


def test_service_filters(spark):
    from frames import taps
    from tapflow.operators import taps as T
    both = taps(spark, [("a", "b")]).unionByName(taps(spark, [("c", "d")], service="B", direction=2))
    assert [r.source for r in T.for_service(both, "B", 2).collect()] == ["c"]
    two = route(spark, "A", 1, ["a"]).unionByName(route(spark, "A", 2, ["b"]))
    assert [r.stop for r in T.for_service(two, "A", 2).collect()] == ["b"]


def test_overlapping_versions_keep_all_rows(spark):
    a = route(spark, "A", 1, ["x", "y"])
    b = route(spark, "A", 1, ["x", "z"], [1.0, 3.0])
    kept = R.unique_occurrences(a.unionByName(b).unionByName(a))
    assert sorted((r.seq, r.stop, r.km) for r in kept.collect()) == [(1, "x", 1.0), (2, "y", 2.0), (2, "z", 3.0)]
    assert [(r.seq, r.versions) for r in R.conflicting_occurrences(a.unionByName(b)).collect()] == [(2, 2)]


def test_session_settings_set_the_time_zone():
    from tapflow.session import recommended_conf
    assert recommended_conf()["spark.sql.session.timeZone"] == "Asia/Singapore"
    assert recommended_conf(time_zone="UTC")["spark.sql.session.timeZone"] == "UTC"
