"""Data model: logical column names, physical-name maps and fixed values.

Operators only ever see the logical names below. Physical names are mapped
once at ingest (``TapColumns.standardise`` / ``RouteColumns.standardise``),
so a table with different column names needs a different map, not different
operators.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The grouping key of every per-route result: one service in one direction.
ROUTE_KEY = ("service", "direction")

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Weekday names accepted by the operational-weekday filter, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# The working-day set and the peak band the analyses use.
WORKING_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
AM_PEAK = (time(7, 30), time(9, 30))
# A ride before 03:00 belongs to the previous operational day.
OPERATIONAL_DAY_START_HOUR = 3
# Stop codes are zero padded to five characters.
STOP_CODE_WIDTH = 5
# Suffixes for repeated stops: first (origin), intermediate, last (destination).
SUFFIX_ORIGIN, SUFFIX_INTERMEDIATE, SUFFIX_DESTINATION = "_O", "_I", "_D"
# Top-k rule for O-D pairs: above 300 pairs keep 1 %, else keep 3.
TOP_PAIRS_THRESHOLD, TOP_PAIRS_FRACTION_DIVISOR, TOP_PAIRS_SMALL_K = 300, 100, 3
# Histogram bins per half of the distance feature.
HISTOGRAM_BINS = 10
# Route-length rule: a route shorter than 12 km and with fewer than 20 stops is left out.
MIN_ROUTE_KM, MIN_ROUTE_STOPS = 12.0, 20
# Chart scales: edge opacity and stroke width ranges.
EDGE_OPACITY_RANGE = (0.1, 0.5)
EDGE_WIDTH_RANGE = (0.1, 3.0)
# Date format of the route validity columns in the route CSV.
ROUTE_DATE_FORMAT = "dd/MM/yyyy"


@dataclass(frozen=True)
class TapColumns:
    """Physical column names of the tap table (defaults: the card-data export)."""

    source: str = "BOARDING_STOP_STN"
    destination: str = "ALIGHTING_STOP_STN"
    year: str = "Year"
    bus: str = "BUS_REG_NUM"
    trip: str = "Bus_Trip_Num"
    journey_id: str = "JOURNEY_ID"
    mode: str = "TRAVEL_MODE"
    service: str = "Srvc_Number"
    direction: str = "Direction"
    ride_km: str = "Ride_Distance"
    tap_in: str = "tap_in_time"
    tap_out: str = "tap_out_time"
    date: str | None = "Date"

    def standardise(self, df: DataFrame) -> DataFrame:
        """Project to logical names (column pruning happens here, once)."""
        cols = [F.col(phys).alias(logical) for logical, phys in asdict(self).items() if phys]
        out = df.select(*cols)
        if self.date is None:  # date is optional: derive it from tap-in
            out = out.withColumn("date", F.to_date("tap_in"))
        return out.withColumn("direction", F.col("direction").cast("int"))


@dataclass(frozen=True)
class RouteColumns:
    """Physical column names of the route table."""

    service: str = "service"
    direction: str = "direction"
    stop: str = "BusStopCode"
    seq: str = "BusStopSequence"
    km: str = "km"
    dt_from: str = "dt_from"
    dt_to: str = "dt_to"

    def standardise(self, df: DataFrame) -> DataFrame:
        cols = [F.col(phys).alias(logical) for logical, phys in asdict(self).items()]
        return (df.select(*cols)
                .withColumn("direction", F.col("direction").cast("int"))
                .withColumn("seq", F.col("seq").cast("bigint"))
                .withColumn("km", F.col("km").cast("double")))


TAP_LOGICAL = tuple(asdict(TapColumns()).keys())
ROUTE_LOGICAL = tuple(asdict(RouteColumns()).keys())
