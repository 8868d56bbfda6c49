"""Small hand-written tap and route frames (logical column names)."""

from datetime import date, datetime

ROUTE_SCHEMA = "service string, direction int, stop string, seq bigint, km double, dt_from date, dt_to date"
TAP_SCHEMA = ("journey_id bigint, service string, direction int, source string, destination string, "
              "bus string, trip string, ride_km double, mode string, year int, tap_in timestamp_ntz, "
              "tap_out timestamp_ntz, date date")

D0, D1 = date(2024, 1, 1), date(2024, 1, 31)


def route(spark, service, direction, stops, kms=None):
    kms = kms or [float(i + 1) for i in range(len(stops))]
    rows = [(service, direction, s, i + 1, kms[i], D0, D1) for i, s in enumerate(stops)]
    return spark.createDataFrame(rows, ROUTE_SCHEMA)


def taps(spark, rides, service="A", direction=1, when=datetime(2024, 1, 8, 8, 0)):
    """rides: list of (source, destination[, bus, trip[, tap_in]])."""
    rows = []
    for i, r in enumerate(rides):
        src, dst = r[0], r[1]
        bus = r[2] if len(r) > 2 else "B1"
        trip = r[3] if len(r) > 3 else "1"
        t = r[4] if len(r) > 4 else when
        rows.append((i, service, direction, src, dst, bus, trip, 1.0, "Bus", t.year, t, t, t.date()))
    return spark.createDataFrame(rows, TAP_SCHEMA)
