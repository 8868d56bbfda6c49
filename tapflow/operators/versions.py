"""Route versions over a period (P6 as an as-of join): every ride meets the
versions of its route that are valid on its date, so one run can span route
changes.

Rides are first counted by date (A1 with the date as a further key, combined
map-side), so what meets the versions is bounded by O-D pairs and days. The
join is an equi join on route and day bucket: a version's range is laid over
buckets of ``BUCKET_DAYS`` days, clipped to the days that have rides, so an
open end (9999-12-31) makes no more buckets than the rides do, and the dates
are compared within the bucket. No cross join, and no range join over all
versions of all routes.

Matched rides and route rows carry the version in their service key, so every
operator that groups by (service, direction) treats versions apart without
knowing of them; ``split_version`` takes the key apart again. Versions that
overlap on a date each count the rides of that date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapflow.model import ROUTE_KEY
from tapflow.operators.common import sized_broadcast

BUCKET_DAYS = 32
MARK = "@"  # between the service and its version


def od_counts_by_date(taps: DataFrame) -> DataFrame:
    """A1 per date: rides per (service, direction, date, source, destination)."""
    return taps.groupBy(*ROUTE_KEY, "date", "source", "destination").agg(F.count(F.lit(1)).alias("pax"))


def version_key() -> F.Column:
    return F.concat("service", F.lit(MARK), F.col("dt_from").cast("string"), F.lit("/"), F.col("dt_to").cast("string"))


def versioned(routes: DataFrame) -> DataFrame:
    """Route rows with the version in their service key; rows without a
    validity date are never valid and left out."""
    return routes.filter("dt_from is not null and dt_to is not null").withColumn("service", version_key())


def split_version(df: DataFrame) -> DataFrame:
    """``service`` as it was, and ``version`` (``from/to``)."""
    at = F.length("service") - F.length(F.substring_index("service", MARK, -1))
    return df.withColumns({"version": F.substring_index("service", MARK, -1),
                           "service": F.substring(F.col("service"), F.lit(1), at - 1)})


def _bucket(day: F.Column, days: int) -> F.Column:
    return F.floor(F.unix_date(day) / days)


def as_of(counts: DataFrame, routes: DataFrame, period: tuple[str, str], bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The counts by date joined to the versions of their route that are valid
    on the date, summed over dates: (service with version, direction, source,
    destination, pax). ``period`` (first, last date) bounds the counts."""
    first, last = (F.to_date(F.lit(d)) for d in period)
    versions = (routes.select(*ROUTE_KEY, "dt_from", "dt_to").distinct().withColumn("key", version_key())
                .filter((F.col("dt_from") <= F.col("dt_to")) & (F.col("dt_from") <= last) & (F.col("dt_to") >= first)))
    laid = versions.withColumn("bucket", F.explode(F.sequence(_bucket(F.greatest("dt_from", first), bucket_days),
                                                              _bucket(F.least("dt_to", last), bucket_days))))
    dated = counts.filter(F.col("date").between(first, last)).withColumn("bucket", _bucket(F.col("date"), bucket_days))
    return (dated.join(sized_broadcast(laid), [*ROUTE_KEY, "bucket"])
            .filter(F.col("date").between(F.col("dt_from"), F.col("dt_to")))
            .groupBy(F.col("key").alias("service"), "direction", "source", "destination").agg(F.sum("pax").alias("pax")))
