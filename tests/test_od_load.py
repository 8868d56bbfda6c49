"""O-D resolution, totals, running load, labels and vehicle counts on
hand-written frames (repeated stops, fan-out, unknown stops)."""

from datetime import datetime

import pyspark.sql.functions as F

from frames import route, taps
from tapflow.operators import load as L
from tapflow.operators import od as OD
from tapflow.operators import routes as R


def test_repeated_stop_fans_out_per_seq_pair(spark):
    r = route(spark, "A", 1, ["a", "x", "b", "x", "c"])
    t = taps(spark, [("x", "c"), ("a", "x"), ("x", "x")])
    per_pair = sorted((row.source, row.destination, row.source_seq, row.destination_seq, row.pax)
                      for row in OD.trips(t, r, "per_seq_pair").collect())
    assert per_pair == [("a", "x", 1, 2, 1), ("a", "x", 1, 4, 1), ("x", "c", 2, 5, 1),
                        ("x", "c", 4, 5, 1), ("x", "x", 2, 4, 1)]
    per_od = sorted((row.source, row.destination, row.source_seq, row.destination_seq)
                    for row in OD.trips(t, r, "per_od").collect())
    assert per_od == [("a", "x", 1, 2), ("x", "c", 4, 5), ("x", "x", 2, 4)]


def test_totals_balance_and_load_returns_to_zero(spark):
    r = route(spark, "A", 1, ["a", "b", "c", "d"])
    t = taps(spark, [("a", "c"), ("a", "d"), ("b", "d"), ("c", "d"), ("d", "a"), ("zz", "d")])
    tr = OD.trips(t, r)
    tot = OD.stop_totals(tr, r)
    s = tot.agg(F.sum("boardings"), F.sum("alightings")).first()
    assert s[0] == s[1] == tr.agg(F.sum("pax")).first()[0] == 4
    loads = [row.load for row in L.running_load(tot).orderBy("seq").collect()]
    assert loads == [2, 3, 3, 0]


def test_dense_matrix_rows(spark):
    r = route(spark, "A", 1, ["a", "b", "c"])
    t = taps(spark, [("a", "c"), ("a", "c"), ("b", "c")])
    rows = {row.seq: (list(row.pax_to), row.boardings)
            for row in OD.od_matrix_rows(OD.trips(t, r), r).collect()}
    assert rows == {1: ([0, 0, 2], 2), 2: ([0, 0, 1], 1), 3: ([0, 0, 0], 0)}


def test_stop_labels_modes(spark):
    loop = route(spark, "L", 1, ["p", "q", "p", "r", "p"])
    odi = {row.seq: row.label for row in R.stop_labels(loop, "odi").collect()}
    assert odi == {1: "p_O", 2: "q", 3: "p_I", 4: "r", 5: "p_D"}
    term = {row.seq: row.label for row in R.stop_labels(loop, "terminal").collect()}
    assert term == {1: "p_O", 2: "q", 3: "p", 4: "r", 5: "p_D"}
    twice = route(spark, "T", 1, ["a", "k", "b", "k", "c"])
    assert {row.seq: row.label for row in R.stop_labels(twice, "odi").collect()} == \
        {1: "a", 2: "k_O", 3: "b", 4: "k_D", 5: "c"}


def test_tap_sides_for_a_stop_served_three_times(spark):
    r = route(spark, "L", 1, ["p", "q", "p", "r", "p"])   # p at positions 0, 2, 4
    t = taps(spark, [("p", "q"), ("p", "r"), ("q", "p"), ("r", "p"), ("p", "zz")], service="L")
    got = {(row.source, row.destination): (row.board_label, row.alight_label)
           for row in L.tap_labels(t, r, "odi").collect()}
    assert got[("p", "q")] == ("p_O", "q")       # q first at 1 <= 2
    assert got[("p", "r")] == ("p_I", "r")       # r first at 3 > 2
    assert got[("q", "p")] == ("q", "p_I")       # q first at 1 <= 2
    assert got[("r", "p")] == ("r", "p_D")       # r first at 3 > 2
    assert got[("p", "zz")] == (None, "zz")      # other end not on the route


def test_vehicle_trips_count_distinct_rows_with_nulls(spark):
    r = route(spark, "A", 1, ["a", "b", "c"])
    d1, d2 = datetime(2024, 1, 8, 8), datetime(2024, 1, 9, 8)
    t = taps(spark, [("a", "c", "B1", "1", d1), ("a", "c", "B1", "1", d1), ("a", "b", None, "1", d1),
                     ("a", "b", "B2", None, d1), ("b", "c", "B1", "1", d2)])
    board = {row.seq: row.bus_count for row in L.vehicle_trips_boarding(t, r, "terminal").collect()}
    assert board == {1: 3, 2: 1, 3: 0}
    mean = L.vehicle_trips_mean(t, r, "odi").first()
    # a: 3 boarding on d1; b: 2 alighting on d1 + 1 boarding on d2; c: 1 on d1 + 1 on d2
    assert abs(mean.bus_count - (3 + 3 + 2) / 3) < 1e-12
    assert mean.unplaced_taps == 0
