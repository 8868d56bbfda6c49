"""Test binding: taps from the driver's ``events`` table, routes from ``part``.

The definition is the one in FIXTURES.md §4, written with the DataFrame API.
Routes: one service S<k> for every 40 part keys, both directions, in five
shapes of up to 40 stops, and a straight local service L<k> through the keys
that the shape leaves out, so every part row is a stop; km = running sum of part
size / 10. Some services are short, some were valid
in another year, some have a missing km or none but zeros. Taps: one per
event, a third of them on S0 or L0 (which has no route) and the others spread
over all services and one that has no route, one in eleven on local services; stop sequences are derived from the event id and
value, and mapped to stop codes through the routes (unknown positions become
stop '99999').
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapflow.operators.common import sized_broadcast

UNKNOWN_STOP = "99999"
KEYS_PER_SERVICE = 40
ROUTE_VALID_FROM, ROUTE_VALID_TO = "2024-01-01", "2024-01-31"
FIRST_UNTIL, SECOND_FROM, OVERLAP_FROM = "2024-01-15", "2024-01-16", "2024-01-11"
EXPIRED_FROM, EXPIRED_TO = "2023-01-01", "2023-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def routes_from_parts(part: DataFrame) -> DataFrame:
    """Route table (physical names) derived from ``part``."""
    k = F.expr("cast(p_partkey div 40 as bigint)")
    main, short = F.col("main"), F.col("main") & (F.col("k") % 11 == 5)
    shape = F.when(main, F.col("k") % 5).otherwise(F.lit(0))
    length = F.when(F.col("k") % 11 == 5, F.lit(12)).otherwise(F.lit(40) - F.lit(4) * (F.col("k") % 5))
    km = F.when(main & (F.col("k") % 13 == 8) & (F.col("pos") == 3), F.lit(None)) \
        .when(main & (F.col("k") % 17 == 9), F.lit(0)).otherwise(F.col("p_size"))
    base = (part.select("p_size", k.alias("k"), (F.col("p_partkey") % KEYS_PER_SERVICE + 1).alias("key"))
            .withColumn("len", length).withColumn("main", F.col("key") <= F.col("len"))
            .withColumns({"pos": F.when(main, F.col("key")).otherwise(F.col("key") - F.col("len")),
                          "n": F.when(main, F.col("len")).otherwise(40 - F.col("len"))})
            .withColumns({"per_km": F.when(short, F.lit(100.0)).otherwise(F.lit(10.0)), "size": km, "shape": shape}))
    ways = F.array(F.struct(F.lit(1).alias("direction"), F.col("pos").alias("seq")),
                   F.struct(F.lit(2).alias("direction"), (F.col("n") + 1 - F.col("pos")).alias("seq")))
    dirs = base.select("*", F.explode(ways).alias("w")).select("*", "w.*")
    pos, shape = F.col("pos"), F.col("shape")
    code_key = (F.when(shape.isin(1, 3) & (pos == F.col("n")), F.lit(1))
                .when((shape == 3) & (pos == 14), F.lit(1))
                .when((shape == 4) & (pos == 9), F.lit(4))
                .otherwise(F.col("key")))
    code = (F.lit(40) * F.col("k") + code_key - 1).cast("string")
    w = Window.partitionBy("k", "main", "direction").orderBy("seq")
    expired = F.col("k") % 7 == 6
    running = F.sum("size").over(w).cast("double") / F.col("per_km")
    return dirs.select(
        F.concat(F.when(main, F.lit("S")).otherwise(F.lit("L")), F.col("k").cast("string")).alias("service"),
        F.col("direction"),
        F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code).alias("BusStopCode"),
        F.col("seq").alias("BusStopSequence"),
        F.when(F.col("size").isNotNull(), running).alias("km"),
        F.when(expired, F.to_date(F.lit(EXPIRED_FROM))).otherwise(F.to_date(F.lit(ROUTE_VALID_FROM))).alias("dt_from"),
        F.when(expired, F.to_date(F.lit(EXPIRED_TO))).otherwise(F.to_date(F.lit(ROUTE_VALID_TO))).alias("dt_to"),
    )


def route_versions(part: DataFrame) -> DataFrame:
    """Route table over a longer time, from the whole of ``part``. Services
    whose shape leaves part keys out get a second version that runs straight
    through all forty, from the middle of the month on and without an end; a
    first version of the month ends there, but one service in nine changes
    over gradually, with both versions valid for some days."""
    k, pos = F.expr("cast(p_partkey div 40 as bigint)"), F.col("p_partkey") % KEYS_PER_SERVICE + 1
    partial = (F.col("k") % 5 != 0) | (F.col("k") % 11 == 5)
    number = F.substring("service", 2, 10).cast("bigint")
    changed = ((number % 5 != 0) | (number % 11 == 5)) & (F.col("dt_to") == F.lit(ROUTE_VALID_TO).cast("date"))
    first = routes_from_parts(part).withColumn("dt_to", F.when(changed, F.lit(FIRST_UNTIL).cast("date")).otherwise(F.col("dt_to")))
    ways = F.array(F.struct(F.lit(1).alias("direction"), F.col("pos").alias("seq")),
                   F.struct(F.lit(2).alias("direction"), (41 - F.col("pos")).alias("seq")))
    code = (F.lit(40) * F.col("k") + F.col("pos") - 1).cast("string")
    second = (part.select(k.alias("k"), pos.alias("pos")).filter(partial).select("*", F.explode(ways).alias("w"))
              .select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("service"), "w.direction",
                      F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code).alias("BusStopCode"),
                      F.col("w.seq").alias("BusStopSequence"), F.col("w.seq").cast("double").alias("km"),
                      F.when(F.col("k") % 9 == 4, F.lit(OVERLAP_FROM)).otherwise(F.lit(SECOND_FROM)).cast("date").alias("dt_from"),
                      F.lit("9999-12-31").cast("date").alias("dt_to")))
    return first.unionByName(second)


def taps_from_events(events: DataFrame, part: DataFrame, routes: DataFrame) -> DataFrame:
    """Tap table (physical names) derived from ``events`` and the routes."""
    services = part.select((F.expr("cast(max(p_partkey) div 40 as bigint)") + 1)).scalar()
    k = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")) \
        .otherwise((F.col("user_id") * 7 + F.expr("event_id div 5")) % (services + 1))
    direction = F.when(F.col("event_id") % 331 == 0, F.lit(None)).otherwise(1 + F.col("event_id") % 2)
    local = F.col("event_id") % 11 == 7
    sq = 1 + (F.col("event_id") * 17) % F.when(local, F.lit(12)).otherwise(F.lit(43))
    f = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.concat(F.when(local, F.lit("L")).otherwise(F.lit("S")), k.cast("string")).alias("svc"),
        direction.alias("dirn"),
        F.coalesce(direction, F.lit(1)).alias("jdir"),
        sq.alias("sq"),
        (sq + 1 + F.floor("value").cast("bigint") % 15 - 3).alias("dq"))
    stops = sized_broadcast(routes.select(
        F.col("service").alias("r_service"), F.col("direction").alias("r_direction"),
        F.col("BusStopSequence").alias("r_seq"), F.col("BusStopCode").alias("r_code")))
    a = stops.toDF("a_service", "a_direction", "a_seq", "a_code")
    b = stops.toDF("b_service", "b_direction", "b_seq", "b_code")
    j = (f.join(a, (a.a_service == f.svc) & (a.a_direction == f.jdir) & (a.a_seq == f.sq), "left")
         .join(b, (b.b_service == f.svc) & (b.b_direction == f.jdir) & (b.b_seq == f.dq), "left"))
    return j.select(
        F.col("event_id").alias("JOURNEY_ID"),
        F.col("svc").alias("Srvc_Number"),
        F.col("dirn").cast("int").alias("Direction"),
        F.coalesce("a_code", F.lit(UNKNOWN_STOP)).alias("BOARDING_STOP_STN"),
        F.coalesce("b_code", F.lit(UNKNOWN_STOP)).alias("ALIGHTING_STOP_STN"),
        F.concat(F.lit("B"), (F.col("user_id") % 7).cast("string")).alias("BUS_REG_NUM"),
        F.hour("ts").cast("string").alias("Bus_Trip_Num"),
        F.col("value").alias("Ride_Distance"),
        F.when(F.col("event_type") == "error", F.lit("Train")).otherwise(F.lit("Bus")).alias("TRAVEL_MODE"),
        F.year("ts").cast("int").alias("Year"),
        F.col("ts").alias("tap_in_time"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None))
         .otherwise(F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("tap_out_time"),
        F.to_date("ts").alias("Date"),
    )


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(taps, routes) with physical column names, as in the card-data export."""
    part = table(spark, sf_dir, "part")
    routes = routes_from_parts(part)
    return taps_from_events(table(spark, sf_dir, "events"), part, routes), routes


def write_lines(rows: DataFrame, fields: dict[str, F.Column], path: str, extra: F.Column | None = None) -> None:
    """Add files of CSV lines under the header ``fields`` to the folder
    ``path``; ``extra`` gives, where it is not null, a line to write instead."""
    line = F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in fields.values()])
    one = rows.select(F.coalesce(extra, line).alias(",".join(fields)) if extra is not None else line.alias(",".join(fields)))
    # a separator that does not occur, so that the lines are written as they are
    one.write.mode("append").option("header", True).option("sep", "\u0001").option("quote", "\u0002").csv(path)


def export_routes(routes: DataFrame, path: str) -> None:
    """The route table as a folder of CSV files in two layouts: services with
    an even number in the declared order, the others in another order with a
    surplus column. Sequence 5 is cut off after four fields, sequence 7 has a
    field too many, and a missing km is written as n/a."""
    c = {name: F.col(name) for name in ("service", "direction", "BusStopCode", "BusStopSequence")}
    c |= {"km": F.coalesce(F.col("km").cast("string"), F.lit("n/a"))}
    c |= {d: F.date_format(d, "dd/MM/yyyy") for d in ("dt_from", "dt_to")}
    order = ["direction", "note", "service", "BusStopSequence", "dt_to", "dt_from", "BusStopCode", "km"]
    even = F.substring("service", 2, 10).cast("bigint") % 2 == 0
    for rows, fields in ((routes.filter(even), c), (routes.filter(~even), {n: c.get(n, F.lit("x")) for n in order})):
        first = F.concat_ws(",", *[x.cast("string") for x in list(fields.values())[:4]])
        whole = F.concat_ws(",", *[x.cast("string") for x in fields.values()])
        seq = F.col("BusStopSequence")
        write_lines(rows, fields, path, F.when(seq == 5, first).when(seq == 7, F.concat(whole, F.lit(",?"))))


def export_taps(taps: DataFrame, path: str) -> None:
    """The tap table as a folder of CSV files in two layouts, by the parity
    of the ride's number."""
    c = {n: F.col(n) for n in taps.columns} | {
        n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("tap_in_time", "tap_out_time")}
    turned = dict(reversed(c.items())) | {"ticket": F.lit("adult")}
    odd = F.col("JOURNEY_ID") % 2 == 1
    write_lines(taps.filter(~odd), c, path)
    write_lines(taps.filter(odd), turned, path)
