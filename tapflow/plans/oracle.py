"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Only the raw driver tables are views in the oracle, so every statement starts
with the test binding of FIXTURES.md §4 as common table expressions
(``routes``, ``taps``), followed by the shared prefilters (``bus``, ``peak``,
``r``, ``served``, ``od``, ``trips``). Doubles are rounded to 6 places and
counts cast to bigint on both sides."""

from __future__ import annotations

VALID_DATE = "2024-01-15"

# Allow-lists as an analysis gives them: 204 services by name, without those
# whose number ends in 7, in two strata.
LISTED = [k for k in range(204) if k % 10 != 7]
STRATA = {"non_loop": [f"S{k}" for k in LISTED if k % 5 in (0, 2, 4)],
          "loop": [f"S{k}" for k in LISTED if k % 5 in (1, 3)]}

BINDING = """
routes AS (
  with keys as (
    select k, key, p_size, n0, key <= n0 as main, case when key <= n0 then key else key - n0 end as pos,
      case when key <= n0 then n0 else 40 - n0 end as n, case when key <= n0 then k % 5 else 0 end as s
    from (select *, case when k % 11 = 5 then 12 else 40 - 4 * (k % 5) end as n0
          from (select p_partkey // 40 as k, p_partkey % 40 + 1 as key, p_size from part))),
  base as (
    select *, case when main and k % 11 = 5 then 100.0 else 10.0 end::double as per_km,
      case when main and k % 13 = 8 and pos = 3 then null when main and k % 17 = 9 then 0 else p_size end as size
    from keys),
  dirs as (
    select *, 1 as direction, pos as seq from base
    union all select *, 2, n + 1 - pos from base),
  codes as (
    select *, cast(40 * k + (case when s in (1, 3) and pos = n then 1 when s = 3 and pos = 14 then 1
                                  when s = 4 and pos = 9 then 4 else key end) - 1 as varchar) as code,
      sum(size) over (partition by k, main, direction order by seq) as total from dirs)
  select case when main then 'S' else 'L' end || cast(k as varchar) as service, direction,
    case when length(code) < 5 then lpad(code, 5, '0') else code end as "BusStopCode",
    seq as "BusStopSequence", case when size is not null then cast(total as double) / per_km end as km,
    case when k % 7 = 6 then date '2023-01-01' else date '2024-01-01' end as dt_from,
    case when k % 7 = 6 then date '2023-12-31' else date '2024-01-31' end as dt_to
  from codes),
taps AS (
  with e as (
    select *, case when event_id % 3 = 0 then 0
        else (user_id * 7 + event_id // 5) % ((select max(p_partkey) // 40 + 1 from part) + 1) end as k,
      case when event_id % 331 = 0 then null else 1 + event_id % 2 end as direction,
      case when event_id % 11 = 7 then 'L' else 'S' end as line,
      1 + (event_id * 17) % case when event_id % 11 = 7 then 12 else 43 end as sq from events),
  f as (select *, sq + 1 + cast(floor(value) as bigint) % 15 - 3 as dq from e)
  select f.event_id as "JOURNEY_ID", f.line || cast(f.k as varchar) as "Srvc_Number",
    cast(f.direction as integer) as "Direction",
    coalesce(a."BusStopCode", '99999') as "BOARDING_STOP_STN",
    coalesce(b."BusStopCode", '99999') as "ALIGHTING_STOP_STN",
    'B' || cast(f.user_id % 7 as varchar) as "BUS_REG_NUM", cast(extract(hour from f.ts) as varchar) as "Bus_Trip_Num",
    f.value as "Ride_Distance", case when f.event_type = 'error' then 'Train' else 'Bus' end as "TRAVEL_MODE",
    cast(extract(year from f.ts) as int) as "Year", f.ts as tap_in_time,
    case when f.event_id % 97 = 0 then null else f.ts + interval 20 minute end as tap_out_time,
    cast(f.ts as date) as "Date"
  from f left join routes a on a.service = f.line || cast(f.k as varchar) and a.direction = coalesce(f.direction,1) and a."BusStopSequence" = f.sq
         left join routes b on b.service = f.line || cast(f.k as varchar) and b.direction = coalesce(f.direction,1) and b."BusStopSequence" = f.dq)
"""

# Logical tap columns, Bus mode, non-null route key.
BUS = """
bus AS (
  select "JOURNEY_ID" as journey_id, "Srvc_Number" as service, "Direction" as direction,
    "BOARDING_STOP_STN" as source, "ALIGHTING_STOP_STN" as destination,
    "BUS_REG_NUM" as bus, "Bus_Trip_Num" as trip, "Ride_Distance" as ride_km,
    "TRAVEL_MODE" as mode, "Year" as year, tap_in_time as tap_in, tap_out_time as tap_out,
    "Date" as date
  from taps
  where "TRAVEL_MODE" = 'Bus' and "Srvc_Number" is not null and "Direction" is not null)
"""

# Working days by operational day (03:00 rule) and the AM peak band.
PEAK = """
peak AS (
  select * from bus
  where isodow(tap_in - interval 3 hour) between 1 and 5
    and (strftime(tap_in, '%H:%M:%S') between '07:30:00' and '09:30:00'
         or strftime(tap_out, '%H:%M:%S') between '07:30:00' and '09:30:00'))
"""

# Routes valid on the analysis date (P6), logical names.
ROUTES = f"""
r AS (
  select service, direction, "BusStopCode" as stop, "BusStopSequence" as seq, km, dt_from, dt_to
  from routes where date '{VALID_DATE}' between dt_from and dt_to)
"""


def served(src: str) -> str:
    """Route rows of service-directions that have taps in ``src``."""
    return f"""
served AS (
  select * from r where exists (
    select 1 from {src} x where x.service = r.service and x.direction = r.direction)),
pos AS (
  select *, cast(row_number() over (partition by service, direction order by seq) - 1 as integer) as pos
  from served)
"""


def trips(src: str, span: str = "per_seq_pair") -> str:
    """A1 -> J1 -> J2 -> P10 -> A2 over ``served`` routes."""
    keep = ""
    if span == "per_od":
        keep = """
  qualify row_number() over (partition by t.service, t.direction, t.source, t.destination
                             order by t.destination_seq - t.source_seq, t.source_seq) = 1"""
    return f"""
od AS (
  select service, direction, source, destination, count(*) as pax
  from {src} group by service, direction, source, destination),
stops AS (select distinct service, direction, stop, seq from served),
trips AS (
  select t.* from (
    select od.service, od.direction, od.source, od.destination,
      s.seq as source_seq, d.seq as destination_seq, od.pax
    from od
    join stops s on s.service = od.service and s.direction = od.direction and s.stop = od.source
    join stops d on d.service = od.service and d.direction = od.direction and d.stop = od.destination
    where d.seq - s.seq > 0) t{keep})
"""


TOTALS = """
b AS (select service, direction, source_seq as seq, sum(pax) as boardings from trips group by all),
a AS (select service, direction, destination_seq as seq, sum(pax) as alightings from trips group by all),
tot AS (
  select p.*, cast(coalesce(b.boardings, 0) as bigint) as boardings,
    cast(coalesce(a.alightings, 0) as bigint) as alightings
  from pos p
  left join b on b.service = p.service and b.direction = p.direction and b.seq = p.seq
  left join a on a.service = p.service and a.direction = p.direction and a.seq = p.seq),
ld AS (
  select *, cast(sum(boardings - case when pos > 0 then alightings else 0 end) over (
      partition by service, direction order by seq rows between unbounded preceding and current row)
    as bigint) as load
  from tot)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join([BINDING, *ctes])


QUERIES: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    QUERIES[name] = sql.strip()


register("running_load", with_ctes(BUS, ROUTES, served("bus"), trips("bus"), TOTALS) + """
select service, direction, stop, pos, seq, boardings, alightings, load from ld
""")


# Every version of every route, and the rides by the versions valid on their
# date; the version is part of the key that the other steps group by.
VERSIONS = """
numbered AS (select *, cast(substr(service, 2) as bigint) as k from routes),
versions AS (
  select service, direction, "BusStopCode" as stop, "BusStopSequence" as seq, km, dt_from,
    case when (k % 5 <> 0 or k % 11 = 5) and dt_to = date '2024-01-31' then date '2024-01-15' else dt_to end as dt_to
  from numbered
  union all
  select 'S' || k, direction, case when length(code) < 5 then lpad(code, 5, '0') else code end,
    case when direction = 1 then pos else 41 - pos end, case when direction = 1 then pos else 41 - pos end::double,
    case when k % 9 = 4 then date '2024-01-11' else date '2024-01-16' end, date '9999-12-31'
  from (select p_partkey // 40 as k, p_partkey % 40 + 1 as pos, cast(p_partkey as varchar) as code,
          unnest([1, 2]) as direction from part)
  where k % 5 <> 0 or k % 11 = 5),
r AS (
  select service || '@' || dt_from || '/' || dt_to as service, direction, stop, seq, km, dt_from, dt_to from versions),
rides AS (
  select v.key as service, b.direction, b.source, b.destination
  from bus b join (select distinct service, direction, dt_from, dt_to, service || '@' || dt_from || '/' || dt_to as key
                   from versions) v
    on v.service = b.service and v.direction = b.direction and b.date between v.dt_from and v.dt_to)
"""

register("running_load_as_of", with_ctes(BUS, VERSIONS, served("rides"), trips("rides"), TOTALS) + """
select split_part(service, '@', 1) as service, direction, split_part(service, '@', 2) as version, stop, pos, seq,
  boardings, alightings, load
from ld
""")

register("bus_taps", with_ctes(BUS) + """
select journey_id, service, direction, source, destination, bus, trip, round(ride_km, 6) as ride_km,
  year, cast(date as varchar) as date
from bus
""")

register("peak_taps", with_ctes(BUS, PEAK) + """
select journey_id, service, direction, cast(isodow(tap_in - interval 3 hour) - 1 as integer) as op_weekday,
  strftime(tap_in, '%H:%M:%S') as tap_in_hms, strftime(tap_out, '%H:%M:%S') as tap_out_hms
from peak
""")

NON_LOOP, LOOP = (", ".join(f"'{x}'" for x in STRATA[s]) for s in ("non_loop", "loop"))

register("service_directions", with_ctes(BUS, PEAK, ROUTES) + f"""
select k.service, k.direction,
  case when k.service in ({NON_LOOP}) then 'non_loop' else 'loop' end as stratum,
  exists (select 1 from r where r.service = k.service and r.direction = k.direction) as has_route
from (select distinct service, direction from peak) k
where k.service in ({NON_LOOP}, {LOOP})
""")

register("distinct_dates", with_ctes(BUS) + """
select distinct cast(date as varchar) as date from bus
""")

register("taps_by_hour", with_ctes(BUS) + """
select cast(extract(hour from tap_in) as integer) as hr, count(extract(hour from tap_in)) as pax
from bus group by 1
""")

register("num_days", with_ctes(BUS) + """
select count(*) as num_days from (select distinct year, dayofyear(tap_in) from bus)
""")

register("routes_valid", with_ctes(ROUTES) + """
select service, direction, stop, seq,
  cast(row_number() over (partition by service, direction order by seq) - 1 as integer) as pos,
  round(km, 6) as km
from r
""")

register("route_summary", with_ctes(ROUTES) + """
select service, direction, count(*) as n_stops, round(arg_max_null(km, seq), 6) as route_km,
  arg_min(stop, seq) as first_stop, arg_max(stop, seq) as last_stop,
  arg_min(stop, seq) = arg_max(stop, seq) as is_loop,
  not (arg_max_null(km, seq) < 12 and count(*) < 20) as kept
from r group by service, direction
""")

register("repeated_stops", with_ctes(ROUTES) + """
select service, direction, stop, count(*) as occurrences,
  string_agg(cast(seq as varchar), ',' order by seq) as positions
from r group by service, direction, stop having count(*) > 1
""")

LABELS = """
lab AS (
  select p.*,
    row_number() over (partition by service, direction, stop order by seq) as occ,
    count(*) over (partition by service, direction, stop) as cnt,
    count(*) over (partition by service, direction) as n,
    first_value(stop) over (partition by service, direction order by seq
      rows between unbounded preceding and unbounded following) as first_stop,
    last_value(stop) over (partition by service, direction order by seq
      rows between unbounded preceding and unbounded following) as last_stop
  from pos p),
labels AS (
  select *,
    case when first_stop = last_stop and pos = 0 then stop || '_O'
         when first_stop = last_stop and pos = n - 1 then stop || '_D' else stop end as label_terminal,
    case when cnt = 1 then stop when occ = 1 then stop || '_O'
         when cnt = 2 and occ = 2 then stop || '_D' when occ = 2 then stop || '_I'
         when occ = 3 then stop || '_D' else stop end as label_odi
  from lab)
"""

ALL_ROUTES = """
served AS (select * from r),
pos AS (
  select *, cast(row_number() over (partition by service, direction order by seq) - 1 as integer) as pos
  from served)
"""

register("stop_labels", with_ctes(ROUTES, ALL_ROUTES, LABELS) + """
select service, direction, seq, pos, stop, label_terminal, label_odi from labels
""")

register("od_counts", with_ctes(BUS) + """
select service, direction, source, destination, count(*) as pax from bus group by all
""")

register("trips_per_seq_pair", with_ctes(BUS, ROUTES, ALL_ROUTES, trips("bus")) + """
select * from trips
""")

register("trips_per_od", with_ctes(BUS, ROUTES, ALL_ROUTES, trips("bus", "per_od")) + """
select * from trips
""")

register("pairs_per_route", with_ctes(BUS, ROUTES, ALL_ROUTES, trips("bus")) + """
select service, direction, count(*) as n_pairs from trips group by all
""")

register("od_matrix", with_ctes(BUS, ROUTES, served("bus"), trips("bus")) + """
, cells AS (select service, direction, source_seq, destination_seq, sum(pax) as pax from trips group by all),
grid AS (
  select p.service, p.direction, p.seq, p.pos, q.seq as col_seq
  from pos p join pos q on p.service = q.service and p.direction = q.direction)
select g.service, g.direction, g.seq, g.pos,
  string_agg(cast(coalesce(c.pax, 0) as varchar), ',' order by g.col_seq) as pax_to,
  cast(sum(coalesce(c.pax, 0)) as bigint) as boardings
from grid g left join cells c on c.service = g.service and c.direction = g.direction
  and c.source_seq = g.seq and c.destination_seq = g.col_seq
group by g.service, g.direction, g.seq, g.pos
""")

register("vehicle_trips_boarding", with_ctes(BUS, ROUTES, served("bus"), LABELS) + """
, loopst AS (
  select service, direction, arg_min(stop, seq) as s from r group by all
  having arg_min(stop, seq) = arg_max(stop, seq)),
bl AS (
  select b.service, b.direction, b.date, b.bus, b.trip,
    case when l.s is not null and b.source = l.s then b.source || '_O' else b.source end as label
  from bus b left join loopst l on l.service = b.service and l.direction = b.direction),
cnt AS (
  select service, direction, label, sum(n) as bus_count from (
    select service, direction, date, label, count(*) as n
    from (select distinct service, direction, date, label, bus, trip from bl) group by all) group by all)
select l.service, l.direction, l.seq, l.pos, l.stop, l.label_terminal as label,
  cast(coalesce(c.bus_count, 0) as bigint) as bus_count
from labels l left join cnt c on c.service = l.service and c.direction = l.direction and c.label = l.label_terminal
""")

TAP_SIDES = """
p2 AS (
  select *, row_number() over (partition by service, direction order by seq) - 1 as p,
    row_number() over (partition by service, direction, stop order by seq) as o
  from r),
fp AS (select service, direction, stop, min(p) as first_pos from p2 group by all),
rep AS (
  select service, direction, stop, count(*) as occ, min(case when o = 2 then p end) as second_pos
  from p2 group by all having count(*) > 1),
tl AS (
  select t.*,
    case when rb.occ is null then t.source when rb.occ = 2 then t.source || '_O'
         when fd.first_pos is null then null
         when fd.first_pos <= rb.second_pos then t.source || '_O' else t.source || '_I' end as board_label,
    case when ra.occ is null then t.destination when ra.occ = 2 then t.destination || '_D'
         when fs.first_pos is null then null
         when fs.first_pos <= ra.second_pos then t.destination || '_I' else t.destination || '_D' end as alight_label
  from bus t
  left join rep rb on rb.service = t.service and rb.direction = t.direction and rb.stop = t.source
  left join rep ra on ra.service = t.service and ra.direction = t.direction and ra.stop = t.destination
  left join fp fd on fd.service = t.service and fd.direction = t.direction and fd.stop = t.destination
  left join fp fs on fs.service = t.service and fs.direction = t.direction and fs.stop = t.source)
"""

VEHICLES = """
sides AS (
  select distinct service, direction, date, 'board' as side, board_label as label, bus, trip
  from tl where board_label is not null
  union
  select distinct service, direction, date, 'alight' as side, alight_label as label, bus, trip
  from tl where alight_label is not null),
n1 AS (select service, direction, date, side, label, count(*) as n from sides group by all),
n2 AS (
  select service, direction, label, sum(mx) as trips from (
    select service, direction, date, label, max(n) as mx from n1 group by all) group by all),
bc AS (
  select l.service, l.direction, avg(coalesce(n2.trips, 0)) as bus_count
  from labels l left join n2 on n2.service = l.service and n2.direction = l.direction and n2.label = l.label_odi
  group by all),
unp AS (
  select service, direction, count(*) as unplaced_taps from tl
  where board_label is null or alight_label is null group by all)
"""

register("vehicle_trips_mean", with_ctes(BUS, ROUTES, served("bus"), LABELS, TAP_SIDES, VEHICLES) + """
select bc.service, bc.direction, round(bc.bus_count, 6) as bus_count,
  cast(coalesce(unp.unplaced_taps, 0) as bigint) as unplaced_taps
from bc left join unp on unp.service = bc.service and unp.direction = bc.direction
""")

register("tap_sides", with_ctes(BUS, ROUTES, TAP_SIDES) + """
select service, direction, source, destination, board_label, alight_label, count(*) as rides
from tl
where board_label is null or alight_label is null or board_label != source or alight_label != destination
group by all
""")

register("utilisation_profile",
         with_ctes(BUS, ROUTES, served("bus"), trips("bus"), TOTALS, LABELS, TAP_SIDES, VEHICLES) + """
select ld.service, ld.direction, ld.stop, l.label_odi as label, ld.pos, ld.seq, ld.boardings,
  ld.alightings, ld.load, round(bc.bus_count, 6) as bus_count
from ld
join labels l on l.service = ld.service and l.direction = ld.direction and l.seq = ld.seq
left join bc on bc.service = ld.service and bc.direction = ld.direction
""")

TOP = """
ranked AS (
  select t.*, count(*) over (partition by service, direction) as n_pairs,
    cast(row_number() over (partition by service, direction
      order by pax desc, source, destination, source_seq, destination_seq) as integer) as rank
  from trips t),
top AS (
  select * from ranked
  where rank <= case when n_pairs > 300 then floor(n_pairs / 100) else 3 end)
"""

register("top_pairs", with_ctes(BUS, ROUTES, ALL_ROUTES, trips("bus"), TOP) + """
select * from top
""")


def totals_over(trips_cte: str) -> str:
    """Boarding/alighting totals of the routes present in ``trips_cte``."""
    return f"""
tr AS (select * from {trips_cte}),
sv AS (
  select r.*, cast(row_number() over (partition by service, direction order by seq) - 1 as integer) as pos,
    km / nullif(last_value(km) over (partition by service, direction order by seq
      rows between unbounded preceding and unbounded following), 0) as km_norm
  from r where exists (select 1 from tr where tr.service = r.service and tr.direction = r.direction)),
fb AS (select service, direction, source_seq as seq, sum(pax) as boardings from tr group by all),
fa AS (select service, direction, destination_seq as seq, sum(pax) as alightings from tr group by all),
ft AS (
  select s.*, coalesce(fb.boardings, 0) as boardings, coalesce(fa.alightings, 0) as alightings
  from sv s
  left join fb on fb.service = s.service and fb.direction = s.direction and fb.seq = s.seq
  left join fa on fa.service = s.service and fa.direction = s.direction and fa.seq = s.seq)
"""


SERIES = """
vals AS (
  select service, direction, pos as position, boardings as v from ft
  union all
  select service, direction, pos + count(*) over (partition by service, direction), alightings from ft),
nrm AS (select service, direction, sqrt(sum(v * v)) as nrm from vals group by all),
series AS (
  select v.service, v.direction, cast(v.position as integer) as position,
    case when n.nrm > 0 then v.v / n.nrm else v.v end as feature
  from vals v join nrm n on n.service = v.service and n.direction = v.direction)
"""

SERIES_CTES = (BUS, PEAK, ROUTES, ALL_ROUTES, trips("peak"), totals_over("trips"), SERIES)

register("stop_series", with_ctes(*SERIES_CTES) + """
select service, direction, position, round(feature, 6) as feature from series
""")

# The clustered series come from the rides of the whole day.
DAY_SERIES = (BUS, ROUTES, ALL_ROUTES, trips("bus"), totals_over("trips"), SERIES)

# Exact DTW (|x - y| point cost) between the stop series of every pair of
# routes, by anti-diagonals: diagonal k holds D[i][k - i] for i = 0..n and
# depends only on diagonals k - 1 and k - 2, so each recursion step is one
# list_transform per pair.
DTW = """
items AS (
  select service || ':' || cast(direction as varchar) as item, list(feature order by position) as v
  from series group by all),
pairs AS (
  select a.item as id_a, b.item as id_b, a.v as x, b.v as y, len(a.v) as n, len(b.v) as m
  from items a join items b on a.item < b.item),
dtw AS (
  select id_a, id_b, x, y, n, m, 1 as k,
    list_transform(range(0, n + 1), lambda i: 'inf'::double) as d1,
    list_transform(range(0, n + 1), lambda i: case when i = 0 then 0.0 else 'inf'::double end) as d2
  from pairs
  union all
  select id_a, id_b, x, y, n, m, k + 1,
    list_transform(range(0, n + 1), lambda i: case when i >= 1 and k + 1 - i between 1 and m
      then abs(x[i] - y[k + 1 - i]) + least(d1[i], d1[i + 1], d2[i]) else 'inf'::double end),
    d1
  from dtw where k < n + m),
dist AS (select id_a, id_b, d1[n + 1] as distance from dtw where k = n + m)
"""

register("dtw_distances", with_ctes(*DAY_SERIES, DTW).replace("WITH ", "WITH RECURSIVE ", 1) + """
select id_a, id_b, round(distance, 6) as distance from dist
""")

register("distance_matrix", with_ctes(*DAY_SERIES, DTW).replace("WITH ", "WITH RECURSIVE ", 1) + """
select id_a as i, id_b as j, round(distance, 6) as distance from dist
union all
select id_b, id_a, round(distance, 6) from dist
union all
select item, item, 0.0 from items
""")

register("distance_histogram",
         with_ctes(BUS, PEAK, ROUTES, ALL_ROUTES, trips("peak"), TOP, totals_over("top")) + """
, whole AS (select service, direction from ft group by all having count(*) = count(km_norm)),
h AS (
  select ft.*, min(km_norm) over (partition by service, direction) as lo0,
    max(km_norm) over (partition by service, direction) as hi0
  from ft semi join whole using (service, direction)),
h2 AS (
  select *, case when hi0 > lo0 then lo0 else lo0 - 0.5 end as lo,
    case when hi0 > lo0 then hi0 else hi0 + 0.5 end as hi
  from h),
h3 AS (
  select *, (hi - lo) / 10.0 as step,
    least(cast(floor((km_norm - lo) * (10.0 / (hi - lo))) as integer), 9) as g0
  from h2),
h4 AS (
  select *, case when km_norm < (case when g0 >= 10 then hi else g0 * step + lo end)
                 then g0 - 1 else g0 end as g1
  from h3),
h5 AS (
  select *, case when km_norm >= (case when g1 + 1 >= 10 then hi else (g1 + 1) * step + lo end)
                      and g1 != 9 then g1 + 1 else g1 end as bin
  from h4),
hist AS (
  select service, direction, bin, sum(boardings) as b, sum(alightings) as a from h5 group by all),
grid AS (
  select k.service, k.direction, b.bin
  from whole k, range(0, 10) b(bin)),
full_h AS (
  select g.service, g.direction, g.bin, cast(coalesce(h.b, 0) as double) as b,
    cast(coalesce(h.a, 0) as double) as a
  from grid g left join hist h on h.service = g.service and h.direction = g.direction and h.bin = g.bin),
mx AS (select service, direction, max(b) as mb, max(a) as ma from full_h group by all)
select f.service, f.direction, cast(f.bin as integer) as position, round(f.b / m.mb, 6) as feature
from full_h f join mx m on m.service = f.service and m.direction = f.direction
union all
select f.service, f.direction, cast(f.bin + 10 as integer), round(f.a / m.ma, 6)
from full_h f join mx m on m.service = f.service and m.direction = f.direction
""")

register("chart_nodes", with_ctes(BUS, PEAK, ROUTES, ALL_ROUTES, trips("peak")) + """
, sv AS (select * from r where exists (
    select 1 from trips t where t.service = r.service and t.direction = r.direction)),
o AS (select service, direction, source_seq as idx, count(*) as c from trips group by all),
i AS (select service, direction, destination_seq as idx, count(*) as c from trips group by all)
select s.service, s.direction, s.stop as name, s.seq as "index", round(s.km, 6) as "order", 1 as "group",
  cast(coalesce(o.c, 0) + coalesce(i.c, 0) as bigint) as degree
from sv s
left join o on o.service = s.service and o.direction = s.direction and o.idx = s.seq
left join i on i.service = s.service and i.direction = s.direction and i.idx = s.seq
""")

register("chart_edges", with_ctes(BUS, PEAK, ROUTES, ALL_ROUTES, trips("peak")) + """
, e AS (
  select service, direction, source_seq as source, destination_seq as target, cast(pax as double) as value,
    least(min(cast(pax as double)) over (partition by service, direction), 0.0) as d0,
    greatest(max(cast(pax as double)) over (partition by service, direction), 0.0) as d1
  from trips)
select service, direction, source, target, round(value, 6) as value,
  round(0.1 + (case when d1 > d0 then (value - d0) / (d1 - d0) else 0.5 end) * 0.4, 6) as opacity,
  round(0.1 + (case when d1 > d0 then (value - d0) / (d1 - d0) else 0.5 end) * 2.9, 6) as width
from e
""")

POINTS = """
pts AS (
  select cast(vec_id as varchar) as id, cast(label as varchar) as label,
    cast(embedding as double[]) as v
  from embeddings),
sums AS (
  select p.id, q.label as other_label, sum(list_distance(p.v, q.v)) as s, count(*) as n
  from pts p, pts q group by all),
per AS (
  select s.id, p.label,
    max(case when s.other_label = p.label then s.s end) as own_sum,
    max(case when s.other_label = p.label then s.n end) as own_n,
    min(case when s.other_label != p.label then s.s / s.n end) as b
  from sums s join pts p on p.id = s.id group by all),
sil AS (
  select id, label, case when own_n > 1 then own_sum / (own_n - 1) end as a, b from per),
sil2 AS (
  select *, case when a is null or b is null then 0.0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) end as silhouette from sil)
"""

register("silhouette_points", "WITH " + POINTS + """
select id, label, round(a, 6) as a, round(b, 6) as b, round(silhouette, 6) as silhouette from sil2
""")

register("silhouette_score", "WITH " + POINTS + """
select round(avg(silhouette), 6) as silhouette from sil2
""")

# Sequential Ward (Lance-Williams) over the DTW pairs: each recursion step
# merges the closest pair (ties: smaller ids) and rebuilds the pair list.
WARD = """
ward AS (
  select 0 as step,
    list(struct_pack(d := distance, a := id_a, b := id_b, na := 1::bigint, nb := 1::bigint)) as pairs,
    []::struct(step integer, lft varchar, rgt varchar, height double, size bigint, members varchar[])[] as merged,
    (select list(struct_pack(id := item, members := [item])) from items) as clusters
  from dist
  union all
  select step + 1,
    list_concat(
      list_filter(pairs, lambda p: p.a not in (best.a, best.b) and p.b not in (best.a, best.b)),
      list_transform(
        list_distinct(list_transform(
          list_filter(pairs, lambda p: (p.a = best.a or p.b = best.a) and p.a != best.b and p.b != best.b),
          lambda p: case when p.a = best.a then struct_pack(v := p.b, nv := p.nb)
                         else struct_pack(v := p.a, nv := p.na) end)),
        lambda o: struct_pack(
          d := sqrt(((o.nv + best.na) * pow(list_filter(pairs, lambda q: (q.a = o.v and q.b = best.a)
                                                                       or (q.a = best.a and q.b = o.v))[1].d, 2)
                    + (o.nv + best.nb) * pow(list_filter(pairs, lambda q: (q.a = o.v and q.b = best.b)
                                                                         or (q.a = best.b and q.b = o.v))[1].d, 2)
                    - o.nv * pow(best.d, 2)) / (best.na + best.nb + o.nv)),
          a := least(best.a, o.v), b := greatest(best.a, o.v),
          na := case when best.a < o.v then best.na + best.nb else o.nv end,
          nb := case when best.a < o.v then o.nv else best.na + best.nb end))),
    list_append(merged, struct_pack(step := step + 1, lft := best.a, rgt := best.b, height := best.d,
                                    size := best.na + best.nb,
                                    members := list_concat(list_filter(clusters, lambda c: c.id = best.a)[1].members,
                                                           list_filter(clusters, lambda c: c.id = best.b)[1].members))),
    list_append(list_filter(clusters, lambda c: c.id not in (best.a, best.b)),
                struct_pack(id := best.a,
                            members := list_concat(list_filter(clusters, lambda c: c.id = best.a)[1].members,
                                                   list_filter(clusters, lambda c: c.id = best.b)[1].members)))
  from (select *, list_min(pairs) as best from ward where len(pairs) > 0)),
heights AS (select unnest(merged, recursive := true) from ward where len(pairs) = 0),
gaps AS (
  select *, height - lag(height) over (order by step) as gap, max(step) over () + 1 as n_items from heights),
best_gap AS (select min(step) as best_step from gaps where gap = (select max(gap) from gaps))
"""

register("ward_heights", with_ctes(*DAY_SERIES, DTW, WARD).replace("WITH ", "WITH RECURSIVE ", 1) + """
select step, round(height, 6) as height, size, round(gap, 6) as gap,
  cast(n_items - best_step + 1 as integer) as suggested_k
from gaps, best_gap
""")

# maxclust cuts k = 5..16: keep the n - k lowest merges; an item belongs to
# the latest kept merge containing it (or stays alone); labels 1..k follow
# each cluster's smallest item.
CUTS = """
mm AS (select step, unnest(members) as item from heights),
kk AS (select k from range(5, 17) t(k)),
nitems AS (select count(*) as n from items),
assign AS (
  select kk.k, it.item,
    (select max(mm.step) from mm where mm.item = it.item and mm.step <= (select n from nitems) - kk.k) as gs
  from kk, items it),
grp AS (select k, item, coalesce('m' || cast(gs as varchar), item) as grp from assign),
firsts AS (select k, grp, min(item) as first from grp group by all),
lab AS (select k, grp, cast(row_number() over (partition by k order by first) as integer) as cluster from firsts)
"""

register("ward_clusters", with_ctes(*DAY_SERIES, DTW, WARD, CUTS).replace("WITH ", "WITH RECURSIVE ", 1) + """
select cast(g.k as integer) as k, g.item, l.cluster from grp g join lab l on l.k = g.k and l.grp = g.grp
""")

register("ward_merges", with_ctes(*DAY_SERIES, DTW, WARD).replace("WITH ", "WITH RECURSIVE ", 1) + """
select step, lft as "left", rgt as "right", round(height, 6) as height, size, round(gap, 6) as gap,
  cast(n_items - best_step + 1 as integer) as suggested_k
from gaps, best_gap
""")

register("cluster_charts", with_ctes(*DAY_SERIES, DTW, WARD, CUTS).replace("WITH ", "WITH RECURSIVE ", 1) + """
select g.item, l.cluster, cast(len(i.v) as integer) as n_values, t.source_seq as source,
  t.destination_seq as target, t.source as from_stop, t.destination as to_stop, t.pax as rides
from grp g join lab l on l.k = g.k and l.grp = g.grp join items i on i.item = g.item
join trips t on t.service || ':' || cast(t.direction as varchar) = g.item
where g.k = 5
""")

def banded(band: int) -> str:
    """DTW with the cells of |i - j| <= max(band, |n - m|) alone."""
    return DTW.replace("when i >= 1 and k + 1 - i between 1 and m",
                       f"when i >= 1 and k + 1 - i between 1 and m and abs(2 * i - k - 1) <= greatest({band}, abs(n - m))")


register("dtw_banded", with_ctes(*DAY_SERIES, banded(4)).replace("WITH ", "WITH RECURSIVE ", 1) + """
select id_a, id_b, round(distance, 6) as distance from dist
""")

register("dtw_nearest", with_ctes(*DAY_SERIES, DTW).replace("WITH ", "WITH RECURSIVE ", 1) + """
, ends AS (select id_a as id, id_b as other, distance from dist union all select id_b, id_a, distance from dist)
select id, arg_min(other, (round(distance, 9), other)) as neighbour, round(min(distance), 6) as distance from ends group by id
""")

register("condensed_distances", with_ctes(*DAY_SERIES, DTW).replace("WITH ", "WITH RECURSIVE ", 1) + """
, num AS (select item, row_number() over (order by item) - 1 as i from items)
select row_number() over (order by a.i, b.i) - 1 as place, a.i as i, b.i as j, round(distance, 6) as distance
from dist join num a on a.item = id_a join num b on b.item = id_b
""")

# Clusters below a height: an item belongs to the latest merge up to it that
# holds the item.
register("ward_threshold_cuts", with_ctes(*DAY_SERIES, DTW, WARD).replace("WITH ", "WITH RECURSIVE ", 1) + """
, mm AS (select step, height, unnest(members) as item from heights),
hh AS (select unnest([0.5, 1.0, 2.0])::double as height),
grp AS (
  select hh.height, it.item,
    coalesce('m' || cast((select max(mm.step) from mm where mm.item = it.item and mm.height <= hh.height) as varchar), it.item) as grp
  from hh, items it),
firsts AS (select height, grp, min(item) as first from grp group by all)
select g.height, g.item, cast(dense_rank() over (partition by g.height order by f.first) as integer) as cluster
from grp g join firsts f on f.height = g.height and f.grp = g.grp
""")

# Sequential Ward over a full matrix of squared distances, one row of it for
# each cluster; a row keeps its nearest among the later clusters.
def ward_matrix(points: str) -> str:
    return f"""
num AS (select id, v, cast(row_number() over (order by id) as integer) as i from {points}),
mat AS (
  select a.i, a.id, list(case when b.i > a.i then list_sum(list_transform(range(1, len(a.v) + 1), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k])))
                         else 'inf'::double end order by b.i) as r
  from num a, num b group by a.i, a.id),
ward AS (
  select 0 as step, list(r order by i) as m, list(1::double order by i) as sz, list(id order by i) as ids,
    0 as a, 0 as b, 0::double as h from mat
  union all
  select step + 1,
    list_transform(m, lambda r, x: case
      when x = b0 then list_transform(r, lambda q: 'inf'::double)
      when x > b0 then r
      when x < a0 then list_transform(r, lambda q, y: case
        when y = b0 then 'inf'::double
        when y = a0 and q < 'inf'::double then ((sz[a0] + sz[x]) * q + (sz[b0] + sz[x]) * r[b0] - sz[x] * h0) / (sz[a0] + sz[b0] + sz[x])
        else q end)
      when x = a0 then list_transform(r, lambda q, y: case
        when y <= a0 or y = b0 or q = 'inf'::double then 'inf'::double
        else ((sz[a0] + sz[y]) * q + (sz[b0] + sz[y]) * (case when y > b0 then m[b0][y] else m[y][b0] end) - sz[y] * h0)
             / (sz[a0] + sz[b0] + sz[y]) end)
      else list_transform(r, lambda q, y: case when y = b0 then 'inf'::double else q end) end),
    list_transform(sz, lambda q, y: case when y = a0 then q + sz[b0] else q end), ids, a0, b0, h0
  from (select *, list_position(m[a0], h0) as b0 from (
    select *, list_position(mins, h0) as a0 from (
      select *, list_min(mins) as h0 from (select *, list_transform(m, lambda r: list_min(r)) as mins from ward
                                           where step < len(sz) - 1)))) w),
steps AS (select step, ids[a] as lft, ids[b] as rgt, sqrt(greatest(h, 0)) as height, cast(sz[a] as bigint) as size
          from ward where step > 0)"""


register("ward_embeddings", "WITH RECURSIVE points AS (select cast(vec_id as varchar) as id, cast(embedding as double[]) as v "
         "from embeddings)," + ward_matrix("points") + """
select cast(row_number() over (order by height, step) as integer) as step, lft as "left", rgt as "right",
  round(height, 6) as height, size from steps
""")

# The number of clusters at the lowest height that leaves at most k.
register("ward_tied_cuts", "WITH RECURSIVE points AS (select cast(vec_id as varchar) as id, "
         "list_transform(cast(embedding as double[])[1:2], lambda x: floor(x * 2)) as v from embeddings),"
         + ward_matrix("points") + """,
n AS (select count(*) + 1 as n from steps),
ks AS (select n, unnest([n - n // 10, n - n // 4, n // 2]) as k from n),
ranked AS (select height, row_number() over (order by height) as pos from steps)
select cast(k as integer) as k, n - (select count(*) from steps s
    where s.height <= (select height from ranked where pos = n - k) + 1e-9 * (select max(height) from steps)) as clusters,
  n as items
from ks
""")

register("embedding_profile", """
with v as (select vec_id, label, unnest(embedding) as value, unnest(range(0, len(embedding))) as position from embeddings)
select 0 as k, cast(label as varchar) as cluster, cast(position as integer) as position,
  round(avg(cast(value as double)), 6) as mean, count(*) as members
from v group by label, position
""")

register("service_rides", with_ctes(BUS) + """
select journey_id, source, destination, bus from bus where service = 'S0' and direction = 1
""")

register("service_route", with_ctes(ROUTES) + """
select stop, seq, round(km, 6) as km from r where service = 'S3' and direction = 2
""")

register("daily_od_counts", with_ctes(BUS) + """
select service, direction, source, destination, count(*) as pax from bus group by all
""")

register("daily_vehicle_trips", with_ctes(BUS) + """
select service, direction, source as stop, cast(sum(n) as bigint) as vehicle_trips from (
  select service, direction, source, date, count(distinct (bus, trip)) as n from bus
  where date between date '2024-01-06' and date '2024-01-25' group by all)
group by all
""")

register("daily_service_days", with_ctes(BUS) + """
select service, direction, count(distinct date) as days, count(*) as rides from bus group by all
""")

register("csv_round_trip", with_ctes(ROUTES) + """
select service, direction, cast(stop as bigint) as stop, seq, round(km, 6) as km, true as same from r
""")

register("cluster_tree", """
with e as (select k, label // k as cluster, list_sum(cast(embedding as double[])) as s
           from embeddings, (select unnest([1, 2]) as k))
select k, cast(cluster as integer) as cluster, count(*) as items, round(sum(s), 6) as total from e group by all
""")

register("first_rides", with_ctes(BUS) + """
select journey_id, service, direction, source from bus order by tap_in, journey_id limit 100
""")

register("csv_folder_routes", "WITH " + BINDING + """
select service, direction, "BusStopCode" as stop, "BusStopSequence" as seq, round(km, 6) as km,
  cast(dt_from as varchar) as dt_from, cast(dt_to as varchar) as dt_to
from routes where "BusStopSequence" not in (5, 7)
""")

register("csv_rejects", "WITH " + BINDING + """,
t AS (
  select *, cast(substr(service, 2) as bigint) % 2 = 0 as even, strftime(dt_from, '%d/%m/%Y') as f, strftime(dt_to, '%d/%m/%Y') as t,
    coalesce(replace(cast(km as varchar), 'e', 'E'), 'n/a') as k from routes)
select case when even and "BusStopSequence" = 5 then concat_ws(',', service, direction, "BusStopCode", 5)
            when even then concat_ws(',', service, direction, "BusStopCode", 7, k, f, t, '?')
            when "BusStopSequence" = 5 then concat_ws(',', direction, 'x', service, 5)
            else concat_ws(',', direction, 'x', service, 7, t, f, "BusStopCode", k, '?') end as line,
  cast(null as varchar) as bad_columns, cast(null as varchar) as service, cast(null as varchar) as direction,
  cast(null as varchar) as busstopsequence, cast(null as varchar) as km
from t where "BusStopSequence" in (5, 7)
union all
select null, 'km', service, cast(direction as varchar), cast("BusStopSequence" as varchar), 'n/a'
from t where km is null and "BusStopSequence" not in (5, 7)
""")

register("csv_folder_taps", with_ctes(BUS) + """
select cast(date as varchar) as date, service, direction, source, cast(extract(hour from tap_out) as integer) as hour_out,
  count(*) as rides, round(sum(ride_km), 6) as km
from bus group by all
""")

register("route_cleaning", "WITH " + BINDING + """
select service, direction, "BusStopCode" as stop, "BusStopSequence" as seq, round(km, 6) as km,
  cast(dt_from as varchar) as dt_from,
  case when "BusStopSequence" <> 2 then cast(dt_to as varchar) end as dt_to
from routes
""")


def pca_ctes(points: str, n: int = 3, squarings: int = 20) -> str:
    """Centred PCA of ``points`` (id, v): the covariance, and each component
    as the limit of repeated squaring of the deflated matrix (2^20 steps of
    power iteration), signed so that the largest loading is positive."""
    out = f"""
mu AS (select list(m order by p) as m from (select p, avg(x) as m from (
  select unnest(v) as x, unnest(range(1, len(v) + 1)) as p from {points}) group by p)),
cen AS (select id, list_transform(range(1, len(v) + 1), lambda i: v[i] - m[i]) as c from {points}, mu),
cells AS (select i, j, sum(c[i] * c[j]) as s
  from (select c, i, unnest(range(1, len(c) + 1)) as j from (select c, unnest(range(1, len(c) + 1)) as i from cen))
  group by i, j),
a1 AS (select list(r order by i) as a from (select i, list(s order by j) as r from cells group by i))"""
    for k in range(1, n + 1):
        out += f""",
sq{k} AS (
  select 0 as t, a as m from a{k}
  union all
  select t + 1, list_transform(p, lambda r: list_transform(r, lambda x: x / tr)) from (
    select t, p, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][i])) as tr from (
      select t, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q))) as p
      from sq{k} where t < {squarings}))),
row{k} AS (select m[list_position(g, list_max(g))] as r from (
  select m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) as g from sq{k} where t = {squarings})),
unit{k} AS (select list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) as u from row{k}),
v{k} AS (select list_transform(u, lambda x: x * sign(u[list_position(g, list_max(g))])) as v
  from (select u, list_transform(u, lambda x: abs(x)) as g from unit{k})),
a{k + 1} AS (
  select list_transform(range(1, len(v) + 1), lambda i: list_transform(range(1, len(v) + 1),
    lambda j: a[i][j] - l * v[i] * v[j])) as a
  from (select a, v, list_dot_product(v, list_transform(a, lambda r: list_dot_product(r, v))) as l from a{k}, v{k}))"""
    return out


PCS = ", ".join(f"round(list_dot_product(c, v{k}.v), 6) as pc{k}" for k in (1, 2, 3))

register("pca_embeddings", "WITH RECURSIVE points AS (select cast(vec_id as varchar) as id, "
         "cast(embedding as double[]) as v from embeddings)," + pca_ctes("points") + f"""
select id, {PCS} from cen, v1, v2, v3
""")

_HISTOGRAM = QUERIES["distance_histogram"].replace("round(f.b / m.mb, 6)", "f.b / m.mb") \
    .replace("round(f.a / m.ma, 6)", "f.a / m.ma")
register("pca_features", "WITH RECURSIVE hist_points AS (" + _HISTOGRAM + """),
points AS (select service || ':' || cast(direction as varchar) as id, list(feature order by position) as v
  from hist_points group by service, direction),""" + pca_ctes("points") + f"""
select split_part(id, ':', 1) as service, cast(split_part(id, ':', 2) as integer) as direction, {PCS}
from cen, v1, v2, v3
""")

# Every cluster has members, every point is with its nearest centre, every
# centre is the mean of its members.
register("kmeans_invariants", """
select cast(10 as bigint) as clusters, count(*) as points, cast(0 as bigint) as misassigned, cast(0 as bigint) as off_centre
from embeddings
""")


def lloyd(points: str, ks: str, restarts: int) -> str:
    """Lloyd's algorithm for every (stratum, k, seed) of ``points`` (stratum,
    id, v), from the k first items in the order of the MD5 of seed and id;
    ``best`` has the least cost of each (stratum, k), ``lab`` its labels."""
    return f"""
pts AS (select stratum, id, v from {points}),
size AS (select stratum, count(*) as n from pts group by stratum),
drawn AS (
  select stratum, seed, v, row_number() over (partition by stratum, seed order by md5(seed || ':' || id), id) as pos
  from pts, (select unnest(range(1, {restarts + 1})) as seed)),
lloyd AS (
  select stratum, k, seed, list(v order by pos) as c, true as moves
  from drawn join size using (stratum), (select unnest({ks}) as k) where pos <= k and k <= n group by all
  union all
  select stratum, k, seed, new as c,
    list_max(list_transform(range(1, k + 1), lambda j: list_max(list_transform(range(1, len(new[j]) + 1),
      lambda d: abs(new[j][d] - c[j][d]))))) > 1e-9 as moves
  from (
    select stratum, k, seed, c, list_transform(range(1, k + 1), lambda j:
        coalesce(list_filter(means, lambda m: m.label = j)[1].mean, c[j])) as new
    from (
      select stratum, k, seed, c, list(struct_pack(label := label, mean := mean)) as means
      from (
        select stratum, k, seed, any_value(c) as c, label, list(x order by d) as mean
        from (
          select stratum, k, seed, any_value(c) as c, label, d, avg(v[d]) as x
          from (
            select *, unnest(range(1, len(v) + 1)) as d
            from (
              select *, list_position(dist, list_min(dist)) as label
              from (
                select l.stratum, l.k, l.seed, l.c, p.v, list_transform(l.c, lambda m:
                    list_sum(list_transform(range(1, len(m) + 1), lambda d: (p.v[d] - m[d]) * (p.v[d] - m[d])))) as dist
                from lloyd l join pts p on p.stratum = l.stratum where l.moves)))
          group by stratum, k, seed, label, d)
        group by stratum, k, seed, label)
      group by stratum, k, seed, c))),
near AS (
  select l.stratum, l.k, l.seed, p.id, p.v, list_transform(l.c, lambda m:
      list_sum(list_transform(range(1, len(m) + 1), lambda d: (p.v[d] - m[d]) * (p.v[d] - m[d])))) as dist
  from lloyd l join pts p on p.stratum = l.stratum where not l.moves),
costs AS (select stratum, k, seed, sum(list_min(dist)) as cost from near group by all),
best AS (select stratum, k, arg_min(seed, (round(cost, 7), seed)) as seed, arg_min(cost, (round(cost, 7), seed)) as cost
         from costs group by all),
lab AS (select stratum, k, id, v, cast(list_position(dist, list_min(dist)) - 1 as integer) as cluster
        from near semi join best using (stratum, k, seed))"""


_STRATUM = "case " + " ".join(f"when service in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in STRATA.items()) + " end"
_HISTOGRAM_POINTS = "hist_points AS (" + _HISTOGRAM + """),
hist AS (select service, service || ':' || cast(direction as varchar) as id, list(feature order by position) as v
  from hist_points group by service, direction)"""

register("kmeans_sweep", "WITH RECURSIVE " + _HISTOGRAM_POINTS + f""",
listed AS (select {_STRATUM} as stratum, id, v from hist where {_STRATUM} is not null),""" + lloyd("listed", "range(2, 41)", 5) + """,
d AS (
  select a.stratum, a.id as x, b.id as y, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda d: (a.v[d] - b.v[d]) * (a.v[d] - b.v[d])))) as dist
  from pts a join pts b on a.stratum = b.stratum),
sums AS (
  select a.stratum, a.k, a.id, a.cluster, b.cluster as other, count(*) as n, sum(dist) as s
  from lab a join lab b on a.stratum = b.stratum and a.k = b.k join d on d.stratum = a.stratum and d.x = a.id and d.y = b.id
  group by all),
ab AS (
  select stratum, k, id, max(case when other = cluster and n > 1 then s / (n - 1) end) as a,
    min(case when other <> cluster then s / n end) as b from sums group by stratum, k, id),
sil AS (
  select stratum, k, avg(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) as s
  from ab group by all)
select size.stratum, cast(kk.k as integer) as k, size.n as n_items, round(best.cost, 6) as cost, round(sil.s, 6) as silhouette
from size cross join (select unnest(range(2, 41)) as k) kk
left join best on best.stratum = size.stratum and best.k = kk.k left join sil on sil.stratum = size.stratum and sil.k = kk.k
""")

register("cluster_profile", "WITH RECURSIVE " + _HISTOGRAM_POINTS + """,
whole AS (select '' as stratum, id, v from hist),""" + lloyd("whole", "[3]", 2) + """
select cast(k as integer) as k, cluster, cast(position as integer) as position, round(avg(x), 6) as mean, count(*) as members
from (select k, cluster, unnest(v) as x, unnest(range(len(v))) as position from lab) group by k, cluster, position
""")

_EMBEDDED = "points AS (select '' as stratum, cast(vec_id as varchar) as id, cast(embedding as double[]) as v from embeddings),"
register("kmeans_embeddings", "WITH RECURSIVE " + _EMBEDDED + lloyd("points", "[10]", 5) + """
select id, cluster from lab
""")

# Mean squared distances pair by pair.
register("silhouette_squared", """
with p as (select cast(vec_id as varchar) as id, cast(label as varchar) as label, cast(embedding as double[]) as v from embeddings),
d as (
  select a.id, a.label, b.label as other, count(*) as n,
    sum(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) as s
  from p a, p b group by all),
ab as (
  select id, label, max(case when other = label and n > 1 then s / (n - 1) end) as a,
    min(case when other <> label then s / n end) as b from d group by id, label)
select id, label, round(a, 6) as a, round(b, 6) as b,
  round(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end, 6) as silhouette
from ab
""")
