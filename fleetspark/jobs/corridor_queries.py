"""Queries over corridors, tunnels, station pairs, vehicle places on a time grid, and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.jobs import network_queries as n
from fleetspark.jobs import tables as t
from fleetspark.jobs.ping_queries import PASSAGE
from fleetspark.jobs.registry import query
from fleetspark.operators import corridors, network, scenarios
from fleetspark.operators import timelines as lines_
from fleetspark.sources import files, fixtures

UNDERGROUND = ("red", "old")
NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def points(spark, sf_dir):
    return fixtures.shape_points(t.view(spark, sf_dir, "route_dir"))


@query(f"""SELECT s.route_id, s.direction_id, CASE WHEN f THEN 0.0::DOUBLE ELSE least(lo, plo) END AS d0, CASE WHEN l THEN length ELSE greatest(hi, phi) END AS d1 FROM (
    SELECT route_id, direction_id, min(d) FILTER (WHERE u) AS lo, max(d) FILTER (WHERE u) AS hi, min_by(u, d) AS f, max_by(u, d) AS l FROM (SELECT route_id, direction_id, d, coalesce(bool_or(starts_with(name, 'red') OR starts_with(name, 'old')), false) AS u FROM stop_name GROUP BY 1, 2, 3) AS k GROUP BY 1, 2) AS s
  JOIN route_dir AS r ON r.route_id = s.route_id AND r.direction_id = s.direction_id LEFT JOIN (
    SELECT route_id, direction_id, min(p.d) AS plo, max(p.d) AS phi FROM (SELECT b.route_id, b.direction_id, a.signal_id, min({{'off': {NEAR}, 'd': b.d}}) AS p FROM signal AS a JOIN shape_point AS b ON {NEAR} < 60 WHERE a.signal_id % 5 = 0 GROUP BY 1, 2, 3) AS k GROUP BY 1, 2) AS p
    ON p.route_id = s.route_id AND p.direction_id = s.direction_id WHERE lo IS NOT NULL AND r.mode = 'rail'""", ("d0", "d1"))  # fmt: skip
def tunnel_ranges(spark, sf_dir):
    """With all names of a stop: of some 50 parts at a stop of sf0.1, the first name in order never is an underground one."""
    portals = t.view(spark, sf_dir, "signal").where("signal_id % 5 = 0").withColumnRenamed("signal_id", "portal_id")
    return corridors.tunnel_ranges(t.view(spark, sf_dir, "stop_name"), points(spark, sf_dir), portals, t.view(spark, sf_dir, "route_dir"), UNDERGROUND)


# The derived pings are few, so one trip is enough for a ride or a pair. The portal of route n is at 2,000 + 100 n metres; a station is the first stop of each 900 m.
STATION = "(SELECT route_id, direction_id, concat('s', CAST(floor(d / 900) AS INT)) AS station, min(d) AS d FROM stop GROUP BY 1, 2, 3)"
ENTRY = "(SELECT route_id, direction_id, 2000.0::DOUBLE + 100 * route_no AS entry FROM route_dir)"


def passage_of(targets: str) -> str:
    """Passages of the distances ``d`` of a table expression."""
    return "(" + PASSAGE.replace("JOIN stop AS s", f"JOIN {targets} AS s") + ")"


PORTAL = f"""(SELECT a.route_id, a.direction_id, a.day, a.trip, CAST(floor(a.t_at / 3600) AS INT) AS hour, b.t_at - a.t_at AS approach, a.t_at AS t0 FROM {ENTRY} AS e
  JOIN {passage_of(f"(SELECT route_id, direction_id, entry - 400 AS d FROM {ENTRY} AS e)")} AS a ON a.route_id = e.route_id AND a.direction_id = e.direction_id
  JOIN {passage_of(f"(SELECT route_id, direction_id, entry AS d FROM {ENTRY} AS e)")} AS b ON b.route_id = a.route_id AND b.direction_id = a.direction_id AND b.day = a.day AND b.trip = a.trip)"""
RIDE = f"""(SELECT p.route_id, p.direction_id, p.day, p.trip, p.hour, s.station, s.d, x.t_at - p.t0 AS ride FROM {PORTAL} AS p JOIN {STATION} AS s USING (route_id, direction_id) JOIN {ENTRY} AS e USING (route_id, direction_id)
  JOIN {passage_of(STATION)} AS x ON x.route_id = p.route_id AND x.direction_id = p.direction_id AND x.day = p.day AND x.trip = p.trip AND x.target = s.d WHERE s.d >= e.entry - 50)"""
SPREAD = "quantile_cont({0}, 0.5) / 60.0::DOUBLE AS median, quantile_cont({0}, 0.9) / 60.0::DOUBLE AS p90, count(*) AS n"
DELAY = f"""(SELECT * FROM (SELECT route_id, direction_id, hour, {SPREAD.format("approach")} FROM {PORTAL} AS p GROUP BY 1, 2, 3) AS k JOIN (SELECT route_id, direction_id, quantile_cont(approach, 0.1) / 60.0::DOUBLE AS free_flow FROM {PORTAL} AS p GROUP BY 1, 2) AS f USING (route_id, direction_id) WHERE n >= 2)"""
TIMES = f"""(SELECT * FROM (SELECT route_id, direction_id, station, hour, {SPREAD.format("ride")} FROM {RIDE} AS r GROUP BY 1, 2, 3, 4) AS k WHERE n >= 1)"""
PAIRS = f"""(SELECT * FROM (SELECT concat(a.station, '|', b.station) AS pair, a.hour, {SPREAD.format("b.ride - a.ride")} FROM {RIDE} AS a JOIN {RIDE} AS b ON a.route_id = b.route_id AND a.direction_id = b.direction_id AND a.day = b.day AND a.trip = b.trip AND a.d < b.d GROUP BY 1, 2) AS k WHERE n >= 1)"""


def stations(spark, sf_dir):
    return t.view(spark, sf_dir, "stop").groupBy("route_id", "direction_id", F.concat(F.lit("s"), F.floor(F.col("d") / 900).cast("int")).alias("station")).agg(F.min("d").alias("d"))


def portal_passages(spark, sf_dir):
    """A stage that all portal reports read."""

    def build():
        entries = t.view(spark, sf_dir, "route_dir").select("route_id", "direction_id", (F.lit(2000.0) + 100 * F.col("route_no")).alias("entry"))
        return corridors.portal_passages(t.moving_pings(spark, sf_dir), entries, stations(spark, sf_dir))

    return files.stage("portal_passages", [fixtures.table(spark, sf_dir, name) for name in ("events", "part")], ("400 m", "900 m"), build)


@query(f"SELECT * FROM {DELAY} AS d", ("median", "p90", "free_flow"))
def portal_delay(spark, sf_dir):
    return corridors.portal_delay(portal_passages(spark, sf_dir))


@query(f"SELECT * FROM {TIMES} AS s", ("median", "p90"))
def portal_station_times(spark, sf_dir):
    return corridors.station_times(portal_passages(spark, sf_dir), least=1)


@query(f"SELECT * FROM {PAIRS} AS p", ("median", "p90"))
def portal_pairs(spark, sf_dir):
    return corridors.pooled_pairs(portal_passages(spark, sf_dir), least=1)


OBSERVED = f"""(SELECT s.route_id, s.direction_id, s.station, s.d, p.day, p.trip, p.t_at FROM {STATION} AS s JOIN {passage_of(STATION)} AS p ON p.route_id = s.route_id AND p.direction_id = s.direction_id AND p.target = s.d)"""
SPANS = f"""(SELECT a.route_id, a.direction_id, concat(a.station, '|', b.station) AS pair, CAST(floor(a.t_at / 3600) AS INT) AS hour, b.t_at - a.t_at AS seconds FROM {OBSERVED} AS a JOIN {OBSERVED} AS b ON a.route_id = b.route_id AND a.direction_id = b.direction_id AND a.day = b.day AND a.trip = b.trip AND a.d < b.d)"""


@query(f"SELECT * FROM (SELECT route_id, direction_id, pair, hour, {SPREAD.format('seconds')} FROM {SPANS} AS s GROUP BY 1, 2, 3, 4) AS k WHERE n >= 1", ("median", "p90"))
def corridor_pair_times(spark, sf_dir):
    return corridors.corridor_pair_times(t.moving_pings(spark, sf_dir), stations(spark, sf_dir), least=1)


@query(f"SELECT *, n / 2.0::DOUBLE AS per_day FROM (SELECT direction_id, pair, hour, {SPREAD.format('seconds')} FROM {SPANS} AS s GROUP BY 1, 2, 3) AS k WHERE n >= 3", ("median", "p90", "per_day"))
def corridor_pair_times_pooled(spark, sf_dir):
    return corridors.corridor_pair_times(t.moving_pings(spark, sf_dir), stations(spark, sf_dir), pooled=True, days=2)


SCHEDULED = """SELECT way, concat(a.station, '|', b.station) AS pair, CAST(floor(a.s / 3600) AS INT) AS hour, count(*) AS trips, quantile_cont(b.s - a.s, 0.5) / 60.0::DOUBLE AS median FROM
  (SELECT *, CASE WHEN last_value(place) OVER w > first_value(place) OVER w THEN 'in' ELSE 'out' END AS way FROM STOPS WINDOW w AS (PARTITION BY trip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS a
  JOIN STOPS AS b ON a.trip_id = b.trip_id AND a.k < b.k AND a.station <> b.station GROUP BY 1, 2, 3""".replace("STOPS", """(SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY s, stop_sequence) AS k FROM (
  SELECT trip_id, stop_sequence, stop_id AS place, concat('{0}', stop_id % {1}) AS station, CAST(substr(departure, 1, 2) AS INT) * 3600 + CAST(substr(departure, 4, 2) AS INT) * 60 AS s FROM stop_time) AS k)""")  # fmt: skip


def scheduled(spark, sf_dir, letter, stations_):
    times = t.view(spark, sf_dir, "stop_time")
    named = times.select("stop_id", F.concat(F.lit(letter), F.col("stop_id") % stations_).alias("station"), F.col("stop_id").alias("place")).distinct()
    return corridors.schedule_pairs(times, named)


@query(SCHEDULED.format("p", 7), ("median",))
def subway_schedule_pairs(spark, sf_dir):
    return scheduled(spark, sf_dir, "p", 7)


# A line 10 m beside each route's way out, a little shorter for each; its stations are the route's.
LINE = "(SELECT route_id AS line, x, y + 10 AS y, bearing, d - 500 AS m FROM shape_point WHERE direction_id = 0 AND d BETWEEN 500 AND 4000 - 300 * CAST(substr(route_id, 2) AS INT))"
ON = f"""(SELECT *, count(*) OVER (PARTITION BY line, route_id, direction_id) AS n FROM (SELECT line, route_id, direction_id, seq, d, bearing, p.m AS m, p.b AS b FROM (
  SELECT a.line, b.route_id, b.direction_id, b.seq, b.d, b.bearing, min({{'off': {NEAR}, 'm': a.m, 'b': a.bearing}}) AS p FROM {LINE} AS a JOIN shape_point AS b ON b.y BETWEEN a.y - 40 AND a.y + 40 AND b.x BETWEEN a.x - 40 AND a.x + 40 AND {NEAR} < 40 AND b.d % 1000 < 950 GROUP BY ALL) AS k) AS k WHERE abs(bearing - b) < 30)"""
RUNS = f"""(SELECT * EXCLUDE (n, run, k) FROM (SELECT *, row_number() OVER (PARTITION BY line, route_id, direction_id ORDER BY n DESC, run) AS k FROM (
  SELECT line, route_id, direction_id, run, count(*) AS n, min_by(d, seq) AS d_on, max_by(d, seq) AS d_off, min_by(m, seq) AS m_on, max_by(m, seq) AS m_off, max_by(m, seq) > min_by(m, seq) AS inbound FROM (
    SELECT *, sum(brk) OVER (PARTITION BY line, route_id, direction_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY line, route_id, direction_id ORDER BY seq) > 4 THEN 1 ELSE 0 END AS brk FROM {ON} AS o WHERE n * 10 >= 800) AS k) AS k
  GROUP BY 1, 2, 3, 4) AS k) AS k WHERE k = 1)"""


@query(f"""SELECT r.*, s.stations FROM {RUNS} AS r JOIN (SELECT r.line, r.route_id, r.direction_id, string_agg(s.station, ',' ORDER BY s.d) AS stations, count(*) AS c FROM {RUNS} AS r JOIN {STATION} AS s ON s.route_id = r.line AND s.direction_id = 0
  WHERE s.d - 500 BETWEEN least(m_on, m_off) - 250 AND greatest(m_on, m_off) + 250 GROUP BY 1, 2, 3) AS s ON s.line = r.line AND s.route_id = r.route_id AND s.direction_id = r.direction_id WHERE c >= 2""", ("d_on", "d_off", "m_on", "m_off"))  # fmt: skip
def corridor_routes(spark, sf_dir):
    """Shapes with a hole of 50 m in each kilometre, so that runs break."""
    shapes = points(spark, sf_dir)
    number = F.substring("route_id", 2, 1).cast("int")
    line = shapes.where((F.col("direction_id") == 0) & F.col("d").between(F.lit(500), 4000 - 300 * number)).select(F.col("route_id").alias("line"), "x", (F.col("y") + 10).alias("y"), "bearing", (F.col("d") - 500).alias("m"))
    at = stations(spark, sf_dir).where("direction_id = 0").select(F.col("route_id").alias("line"), "station", (F.col("d") - 500).alias("m"))
    found = corridors.corridor_routes(shapes.where("d % 1000 < 950"), line, at, hole=4)
    return found.withColumn("stations", F.concat_ws(",", "stations"))


# Routes 0 to 2 are laid on one street; 1 and 2 count as the rapid routes of 0, with every other stop.
@query("""SELECT rapid, 'R0' AS local, direction_id, l.s AS local_s, r.s AS rapid_s, l.n AS local_stops, r.n AS rapid_stops, (l.s - r.s) / (l.n - r.n) AS per_stop FROM (SELECT route_id AS rapid, direction_id, s, n FROM BOTH WHERE route_id IN ('R1', 'R2')) AS r
  JOIN (SELECT * FROM BOTH WHERE route_id = 'R0') AS l USING (direction_id) WHERE l.n > r.n""".replace("BOTH", """(SELECT r.route_id, r.direction_id, coalesce(s, 0.0::DOUBLE) AS s, coalesce(n, 0) AS n FROM route_dir AS r
    LEFT JOIN (SELECT route_id, direction_id, sum(m) AS s FROM (SELECT route_id, direction_id, bin, avg(x) AS m FROM (SELECT route_id, direction_id, bin, day, trip, sum(time) AS x FROM bin_part WHERE hour BETWEEN 7 AND 19 AND bin < 50 GROUP BY ALL) AS k GROUP BY ALL) AS k GROUP BY ALL) AS b USING (route_id, direction_id)
    LEFT JOIN (SELECT route_id, direction_id, count(*) AS n FROM stop WHERE d <= 4990 AND (route_id = 'R0' OR d % 180 = 0) GROUP BY ALL) AS c USING (route_id, direction_id))"""), ("local_s", "rapid_s", "per_stop"))  # fmt: skip
def rapid_vs_local(spark, sf_dir):
    from fleetspark.operators import states

    street = points(spark, sf_dir).withColumn("y", F.col("direction_id") * 1000.0).where("route_id <> 'R3'")
    pairs = t.view(spark, sf_dir, "route_dir").where("route_id in ('R1', 'R2')").select(F.col("route_id").alias("rapid"), F.lit("R0").alias("local"), "direction_id")
    return corridors.rapid_vs_local(states.interval_bins(t.moving_pings(spark, sf_dir)), street, t.view(spark, sf_dir, "stop").where("route_id = 'R0' OR d % 180 = 0"), pairs)


ROW = f"(SELECT day, vehicle_id, p.t, p.x, p.y, CASE WHEN v.trip > 0 THEN v.route_key END AS label, v.route_along AS along FROM ping AS p JOIN {n.VEHICLE_ROW} AS v USING (event_id, day, vehicle_id))"


@query(f"""SELECT day, vehicle_id, t AS at_t, CASE WHEN b THEN least(greatest(al, 0.0::DOUBLE), 4990.0::DOUBLE) ELSE x + f * (bx - x) END AS x, CASE WHEN b THEN 500.0::DOUBLE * CAST(substr(lab, 2, 1) AS INT) + 250 * CAST(substr(lab, 4, 1) AS INT) ELSE y + f * (by_ - y) END AS y,
    CASE WHEN b THEN al ELSE along END AS along, CASE WHEN b THEN lab WHEN f < 1 THEN label ELSE blabel END AS label, b AS bridged FROM (
  SELECT day, vehicle_id, at_t AS t, x, y, bx, by_, along, label, blabel, b, p.label AS lab, p.along + (at_t - p.t) / (q.t - p.t)::DOUBLE * (q.along - p.along) AS al,
    CASE WHEN sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y)) / (bt - t) > 35 THEN CASE WHEN (at_t - t) / (bt - t)::DOUBLE < 0.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE (at_t - t) / (bt - t)::DOUBLE END AS f FROM (
    SELECT *, unnest(range(CAST(ceil(t / 300) * 300 AS INT), bt, 300))::INT AS at_t, coalesce(p.label = q.label AND q.along >= p.along - 30 AND q.t - p.t <= 1200, false) AS b FROM (
      SELECT *, lead(t) OVER w AS bt, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(label) OVER w AS blabel,
        last_value(CASE WHEN label IS NOT NULL AND along >= 0 THEN {{'t': t, 'label': label, 'along': along}} END IGNORE NULLS) OVER (PARTITION BY day, vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
        first_value(CASE WHEN label IS NOT NULL AND along >= 0 THEN {{'t': t, 'label': label, 'along': along}} END IGNORE NULLS) OVER (PARTITION BY day, vehicle_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q
      FROM {ROW} AS r WINDOW w AS (PARTITION BY day, vehicle_id ORDER BY t)) AS k) AS k WHERE b OR bt - t <= 180) AS k""", ("x", "y", "along"))  # fmt: skip
def fleet_at_times(spark, sf_dir):
    rows = n.vehicle_rows(spark, sf_dir)
    rows = rows.select("day", "vehicle_id", "t", "x", "y", F.when(F.col("trip") > 0, F.col("route_key")).alias("label"), F.col("route_along").alias("along"))
    shapes = points(spark, sf_dir).select(F.concat_ws("_", "route_id", "direction_id").alias("label"), "seq", "x", "y")
    return lines_.fleet_at_times(rows, shapes)


def _near(rows: str, keys: str, values: str) -> str:
    """``rows`` at their hour, else the next, else the one before."""
    return f"""(SELECT * EXCLUDE (rank, k) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, hour ORDER BY rank) AS k FROM (
      SELECT {keys}, hour, {values}, 0 AS rank FROM {rows} AS a UNION ALL SELECT {keys}, hour - 1, {values}, 1 FROM {rows} AS a UNION ALL SELECT {keys}, hour + 1, {values}, 2 FROM {rows} AS a) AS u) AS u WHERE k = 1)"""


def _cut(first: int, last: int, way: int, hours: str, at: str) -> str:
    """Minutes over the bins [first, last) of each route's way in ``hours``, from the grid's hour ``at``."""
    return f"""(SELECT s.route_id, h.hour, sum(100.0::DOUBLE / (CASE WHEN g.mph > 0 THEN g.mph ELSE 7.0::DOUBLE END / 2.23694::DOUBLE)) / 60.0::DOUBLE AS minutes FROM (SELECT route_id, direction_id, unnest(range({first}, {last}))::INT AS bin FROM route_dir WHERE direction_id = {way}) AS s
  CROSS JOIN (SELECT unnest(range({hours}))::INT AS hour) AS h LEFT JOIN heat AS g ON g.route_id = s.route_id AND g.direction_id = s.direction_id AND g.bin = s.bin AND g.hour = {at} GROUP BY 1, 2)"""


SERVICE = """(SELECT * FROM (SELECT route_id, CAST(floor(t0 / 3600) AS INT) AS hour, count(*) FILTER (WHERE direction_id = 1) AS tph, quantile_cont(t1 - t0, 0.5) / 30.0::DOUBLE AS round_trip FROM extent GROUP BY 1, 2) AS k WHERE tph > 0)"""


def _truncation(hours: str, at: str, daily: str) -> str:
    return f"""(SELECT route_id, hour, saved, 60.0::DOUBLE / tph AS headway, 60.0::DOUBLE / tph * (cycle - saved) / cycle AS new_headway, cycle / (60.0::DOUBLE / tph) AS buses, saved / (60.0::DOUBLE / tph) AS freed, {daily} AS daily_hours FROM (
  SELECT s.route_id, s.hour, s.tph, round_trip * 1.12::DOUBLE AS cycle, greatest(i.minutes + o.minutes - 4, 0.0::DOUBLE) AS saved FROM {SERVICE} AS s JOIN {_cut(25, 50, 1, hours, at)} AS i ON i.route_id = s.route_id AND i.hour = s.hour JOIN {_cut(0, 25, 0, hours, at)} AS o ON o.route_id = s.route_id AND o.hour = s.hour) AS k)"""


TRUNCATED = _truncation("5, 24", "h.hour", "sum(tph * saved / 60.0::DOUBLE) OVER (PARTITION BY route_id)")
# Every hour with service, as ``segment_minutes`` finds one outside the grid: 4 looks at 5, 24 at 23, others find nothing.
ALL_TRUNCATED = _truncation("0, 48", "CASE WHEN h.hour = 4 THEN 5 WHEN h.hour = 24 THEN 23 ELSE h.hour END", "coalesce(sum(tph * saved / 60.0::DOUBLE) FILTER (WHERE hour BETWEEN 5 AND 23) OVER (PARTITION BY route_id), 0.0::DOUBLE)")


def truncated(spark, sf_dir, hours=range(48)):
    """Every route is cut at 2,500 m."""
    cells = t.heat(spark, sf_dir)
    part = lambda way, d0, d1: scenarios.segment_minutes(t.view(spark, sf_dir, "route_dir").where(F.col("direction_id") == way).select("route_id", "direction_id", F.lit(d0).alias("d0"), F.lit(d1).alias("d1")), cells, "route_id", hours)
    service = t.extents(spark, sf_dir).groupBy("route_id", F.floor(F.col("t0") / 3600).cast("int").alias("hour")).agg(F.count_if(F.col("direction_id") == 1).alias("tph"), (F.percentile(F.col("t1") - F.col("t0"), 0.5) / 30.0).alias("round_trip"))
    return scenarios.corridor_truncation(part(1, 2500.0, 5000.0), part(0, 0.0, 2500.0), service)


DOUBLES = ("saved", "headway", "new_headway", "buses", "freed", "daily_hours")


@query(f"SELECT * FROM {ALL_TRUNCATED} AS t", DOUBLES)
def corridor_truncation(spark, sf_dir):
    return truncated(spark, sf_dir)


BUS = f"(SELECT * FROM (SELECT route_id, pair, hour, quantile_cont(seconds, 0.5) / 60.0::DOUBLE AS stay, quantile_cont(seconds, 0.9) / 60.0::DOUBLE AS stay_p90, count(*) AS n FROM {SPANS} AS s WHERE direction_id = 1 GROUP BY 1, 2, 3) AS k WHERE n >= 1)"
RAIL = f"(SELECT pair, hour, quantile_cont(seconds, 0.5) / 60.0::DOUBLE AS ride, count(*)::DOUBLE AS per_hour FROM {SPANS} AS s WHERE direction_id = 1 AND route_id = 'R3' GROUP BY 1, 2)"


PLANNED = f"(SELECT pair, hour, trips, median FROM ({SCHEDULED.format('s', 6)}) AS k WHERE way = 'in')"


@query(f"""SELECT *, via - gain - stay AS net FROM (SELECT *, 3.0::DOUBLE + wait + ride + 5 AS via FROM (
    SELECT b.route_id, b.pair, b.hour, stay, stay_p90, coalesce(r.ride, p.median) AS ride, p.median AS planned, r.ride IS NOT NULL AS measured, coalesce(p.trips::DOUBLE, r.per_hour) AS trains, 30.0::DOUBLE / coalesce(p.trips::DOUBLE, r.per_hour) AS wait, coalesce((headway - new_headway) / 2, 0.0::DOUBLE) AS gain
    FROM {BUS} AS b LEFT JOIN {RAIL} AS r USING (pair, hour) LEFT JOIN {PLANNED} AS p USING (pair, hour) LEFT JOIN {TRUNCATED} AS t ON t.route_id = b.route_id AND t.hour = b.hour WHERE r.ride IS NOT NULL OR p.median IS NOT NULL) AS k) AS k""", ("stay", "stay_p90", "ride", "planned", "trains", "wait", "via", "gain", "net"))  # fmt: skip
def corridor_transfer_rides(spark, sf_dir):
    """The way in of all routes is the bus; that of route 3, observed, and the schedule's are the rail."""
    pings, at = t.moving_pings(spark, sf_dir), stations(spark, sf_dir).where("direction_id = 1")
    bus = corridors.corridor_pair_times(pings, at, least=1)
    rail = corridors.corridor_pair_times(pings, at.where("route_id = 'R3'"), least=1, pooled=True).withColumnRenamed("per_day", "per_hour")
    return scenarios.transfer_rides(bus, rail, scheduled(spark, sf_dir, "s", 6).where("way = 'in'"), truncated(spark, sf_dir, range(5, 24)))


WAY = "SELECT * FROM {} AS w WHERE direction_id = 1"


@query(f"""SELECT a.route_id, a.hour, greatest(a.median - a.free_flow, 0.0::DOUBLE) AS merge, g.median AS today, g.p90 AS today_p90, a.free_flow + greatest(coalesce(l.median - a.median, 0.0::DOUBLE), 0.0::DOUBLE) + 2 + 2.5::DOUBLE * (1.0::DOUBLE + 0.3::DOUBLE * 0.3::DOUBLE) + p.median AS via,
    a.free_flow + greatest(coalesce(l.p90 - a.p90, 0.0::DOUBLE), 0.0::DOUBLE) + 2 + 5 + p.p90 AS via_bad
  FROM {_near(f"({WAY.format(DELAY)})", "route_id", "median, p90, free_flow")} AS a JOIN {_near(f"({WAY.format(TIMES)})", "route_id, station", "median, p90")} AS g ON g.route_id = a.route_id AND g.hour = a.hour AND g.station = 's4'
  LEFT JOIN {_near(f"({WAY.format(TIMES)})", "route_id, station", "median, p90")} AS l ON l.route_id = a.route_id AND l.hour = a.hour AND l.station = 's3' JOIN {_near(PAIRS, "pair", "median, p90")} AS p ON p.pair = 's3|s4' AND p.hour = a.hour""", ("merge", "today", "today_p90", "via", "via_bad"))  # fmt: skip
def trunk_transfer(spark, sf_dir):
    """Inbound lines change at station 3 for station 4."""
    passed = portal_passages(spark, sf_dir)
    inbound = lambda rows: rows.where("direction_id = 1").drop("direction_id")
    routes = t.view(spark, sf_dir, "route_dir").select("route_id", F.lit("s3").alias("transfer")).distinct()
    return scenarios.trunk_transfer(inbound(corridors.portal_delay(passed)), inbound(corridors.station_times(passed, least=1)), corridors.pooled_pairs(passed, least=1), routes, "s4", 12.0)


LAID = "(SELECT route_id, direction_id, stop_id, d, route_id AS family, d AS x, 60.0::DOUBLE * CAST(substr(route_id, 2) AS INT) + 20 * direction_id AS y FROM stop)"
CLOSE = f"(SELECT a.stop_id, list_sort(list(DISTINCT b.family)) AS fs FROM {LAID} AS a JOIN {LAID} AS b ON a.family <> b.family AND {NEAR} < 120 GROUP BY 1)"


@query(f"""SELECT route_id, direction_id, stop_id, array_to_string(list_sort(list_filter(fs, lambda f: NOT list_contains(beside, f))), ',') AS transfers,
    route_id = 'R0' AND EXISTS (SELECT 1 FROM stop AS r WHERE r.route_id = 'R1' AND r.direction_id = k.direction_id AND r.d = k.d) AS at_rapid FROM (
  SELECT *, list_concat(coalesce(lag(fs) OVER w, []), coalesce(lead(fs) OVER w, [])) AS beside FROM (SELECT s.route_id, s.direction_id, s.stop_id, s.d, coalesce(c.fs, []) AS fs FROM {LAID} AS s LEFT JOIN {CLOSE} AS c USING (stop_id)) AS k
  WINDOW w AS (PARTITION BY route_id, direction_id ORDER BY d, stop_id)) AS k""")  # fmt: skip
def crossing_transfers(spark, sf_dir):
    """Routes are laid 60 m apart, so that their stops are near each other. Route 1 is the rapid sibling of route 0; their stops at one distance are one place."""
    number = F.substring("route_id", 2, 1).cast("int")
    stops = t.view(spark, sf_dir, "stop").select("route_id", "direction_id", "stop_id", "d", F.col("route_id").alias("family"), F.col("d").alias("x"), (60.0 * number + 20 * F.col("direction_id")).alias("y"))
    crossing = scenarios.crossing_families(stops).select("route_id", "direction_id", "stop_id", F.concat_ws(",", F.array_sort("transfers")).alias("transfers"))
    rapid = scenarios.also_rapid(stops.withColumns({"line": F.regexp_replace("route_id", "1", "0"), "rapid": F.col("route_id") == "R1", "place": F.col("d")}))
    return crossing.join(rapid.select("route_id", "direction_id", "stop_id", "at_rapid"), ["route_id", "direction_id", "stop_id"])


@query("""SELECT route_id, direction_id, before, after, (before - after) * 18 AS saved FROM (SELECT route_id, direction_id, sum(CASE WHEN NOT e THEN p ELSE 0.0::DOUBLE END) AS before, sum(CASE WHEN NOT e AND NOT removed THEN 1.0::DOUBLE - (1.0::DOUBLE - p) * exp(coalesce(l, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END) AS after FROM (
    SELECT s.*, m.l FROM ROWS_ AS s LEFT JOIN (SELECT route_id, direction_id, d, sum(ln(1.0::DOUBLE - p / 2)) AS l FROM (SELECT route_id, direction_id, u AS d, p FROM ROWS_ AS a WHERE removed UNION ALL SELECT route_id, direction_id, w AS d, p FROM ROWS_ AS b WHERE removed) AS k WHERE d IS NOT NULL GROUP BY 1, 2, 3) AS m USING (route_id, direction_id, d)) AS k GROUP BY 1, 2) AS k""".replace("ROWS_", """(
    SELECT *, max(CASE WHEN NOT removed THEN d END) OVER (PARTITION BY route_id, direction_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u, min(CASE WHEN NOT removed THEN d END) OVER (PARTITION BY route_id, direction_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS w,
      d = min(d) OVER (PARTITION BY route_id, direction_id) OR d = max(d) OVER (PARTITION BY route_id, direction_id) AS e FROM (SELECT route_id, direction_id, d, d % 180 = 0 AS removed, coalesce(least(1.0::DOUBLE, stopped / 20), 1.0::DOUBLE) AS p FROM dwell) AS k)"""), ("before", "after", "saved"))  # fmt: skip
def stop_removal_savings(spark, sf_dir):
    from fleetspark.operators import grid

    dwell = grid.stop_dwell(t.state_pings(spark, sf_dir), t.extents(spark, sf_dir), t.view(spark, sf_dir, "stop"))
    return scenarios.stop_removal_savings(dwell.withColumn("removed", F.expr("d % 180 = 0")))


PLACES = """SELECT *, (SELECT replace(min({'other': (starts_with(name, 'red') OR starts_with(name, 'old')) <> p.underground, 'far': round(sqrt((sx - p.x) * (sx - p.x) + (sy - p.y) * (sy - p.y)), 6), 'id': stop_id, 'name': name}).name, 'Metro ', '')
      FROM (SELECT stop_id, name, least(floor(d / 10), 499) * 10.0::DOUBLE AS sx, 500.0::DOUBLE * CAST(substr(route_id, 2) AS INT) + 250 * direction_id AS sy FROM stop) AS s) || CASE WHEN underground THEN ' (subway)' ELSE '' END AS name FROM (
  SELECT CAST(floor(x / 150) AS BIGINT) AS cx, CAST(floor(y / 150) AS BIGINT) AS cy, 2 AS heading, route_id <> 'R1' AND bin * 100 + 50 BETWEEN 1000 AND 2000 AS underground, sum(delay) / 3600.0::DOUBLE AS hours, sum(x * w) / sum(w) AS x, sum(y * w) / sum(w) AS y,
    coalesce(sum(delay) FILTER (WHERE route_id <> 'R3'), 0.0::DOUBLE) / 3600.0::DOUBLE AS bus_hours, coalesce(sum(delay) FILTER (WHERE route_id = 'R3'), 0.0::DOUBLE) / 3600.0::DOUBLE AS rail_hours, array_to_string(list_sort(list(DISTINCT route_id) FILTER (WHERE route_id <> 'R3')), ',') AS bus_routes,
    array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes, CASE WHEN sum(s1 + s2 + s3) > 0 THEN sum(s1) / sum(s1 + s2 + s3) ELSE 0 END AS crawl, CASE WHEN sum(s1 + s2 + s3) > 0 THEN sum(s2) / sum(s1 + s2 + s3) ELSE 0 END AS dwell, CASE WHEN sum(s1 + s2 + s3) > 0 THEN sum(s3) / sum(s1 + s2 + s3) ELSE 0 END AS stopped
  FROM (SELECT d.*, bin * 100.0::DOUBLE + 50 AS x, 500.0::DOUBLE * CAST(substr(route_id, 2) AS INT) + 250 * direction_id AS y, delay + 0.000001::DOUBLE AS w, coalesce(s1, 0.0::DOUBLE) AS s1, coalesce(s2, 0.0::DOUBLE) AS s2, coalesce(s3, 0.0::DOUBLE) AS s3
    FROM (SELECT route_id, direction_id, bin, sum(delay) AS delay FROM delay WHERE delay IS NOT NULL AND bin BETWEEN 3 AND 46 GROUP BY 1, 2, 3) AS d LEFT JOIN (SELECT route_id, direction_id, bin, sum(w) FILTER (WHERE state = 1) AS s1, sum(w) FILTER (WHERE state = 2) AS s2, sum(w) FILTER (WHERE state = 3) AS s3 FROM state_ping GROUP BY 1, 2, 3) AS s USING (route_id, direction_id, bin)) AS k
  GROUP BY 1, 2, 3, 4 HAVING sum(delay) / 3600.0::DOUBLE >= 0.01::DOUBLE ORDER BY round(hours, 6) DESC, cx, cy, heading, underground LIMIT 600) AS p"""  # fmt: skip
CAUSE = "CASE WHEN stopped >= dwell AND stopped >= crawl THEN 'stopped' WHEN crawl >= dwell THEN 'crawl' ELSE 'dwell' END AS cause"


def places(spark, sf_dir):
    """All routes but the second run underground from 1,000 to 2,000 m. A stop is at the shape's point before it."""
    tunnels = n.tunnels(spark, sf_dir)
    seconds = t.state_pings(spark, sf_dir).groupBy("route_id", "direction_id", "bin").agg(*[F.sum(F.when(F.col("state") == k, F.col("w"))).alias(f"s{k}") for k in (1, 2, 3)])
    below = F.col("name").startswith(UNDERGROUND[0]) | F.col("name").startswith(UNDERGROUND[1])
    stops = t.view(spark, sf_dir, "stop").withColumn("seq", F.least(F.floor(F.col("d") / 10), F.lit(499)).cast("int"))
    stops = stops.join(points(spark, sf_dir).select("route_id", "direction_id", "seq", "x", "y"), ["route_id", "direction_id", "seq"]).select("stop_id", "name", "x", "y", below.alias("underground"))
    return scenarios.hotspot_places(t.delays(spark, sf_dir), seconds, points(spark, sf_dir), tunnels, stops, least_hours=0.01)


@query(f"SELECT * EXCLUDE (bus_routes) FROM ({PLACES}) AS k", ("hours", "bus_hours", "rail_hours", "x", "y", "crawl", "dwell", "stopped"))
def hotspot_places(spark, sf_dir):
    hours = {f"{mode}_hours": F.coalesce(F.col("by_mode")[mode], F.lit(0.0)) for mode in ("bus", "rail")}
    return places(spark, sf_dir).withColumns(hours | {"routes": F.concat_ws(",", F.array_sort(F.flatten(F.map_values("routes"))))}).drop("by_mode")


@query(f"""SELECT cx, cy, heading, underground, name, hours, {CAUSE}, routes FROM ({PLACES}) AS p
  WHERE hours >= 0.05::DOUBLE ORDER BY round(hours, 6) DESC, cx, cy, heading, underground LIMIT 40""", ("hours",))  # fmt: skip
def hotspot_topk(spark, sf_dir):
    return scenarios.hotspot_topk(places(spark, sf_dir))


@query(f"""SELECT cx, cy, heading, underground, name, bus_hours AS hours, {CAUSE}, bus_routes AS routes FROM ({PLACES}) AS p
  WHERE bus_hours >= 0.05::DOUBLE ORDER BY round(bus_hours, 6) DESC, cx, cy, heading, underground LIMIT 40""", ("hours",))  # fmt: skip
def hotspot_topk_bus(spark, sf_dir):
    return scenarios.hotspot_topk(places(spark, sf_dir), "bus")


# On a straight shape a stop's place is its distance, so the ordered projection has a plain form.
@query("SELECT route_id, direction_id, CAST(row_number() OVER (PARTITION BY route_id, direction_id ORDER BY d) AS INT) AS seq, least(d, 4990.0::DOUBLE) AS d, CAST(stop_id % 40 AS DOUBLE) AS off_line FROM stop", ("d", "off_line"))
def project_stops(spark, sf_dir):
    from pyspark.sql import Window

    shapes, of = points(spark, sf_dir), Window.partitionBy("route_id", "direction_id").orderBy("seq")
    segments = shapes.select("route_id", "direction_id", F.col("seq").alias("k"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(of).alias("x1"), F.lead("y").over(of).alias("y1"), F.col("d").alias("c0")).where("x1 is not null")
    routes = t.view(spark, sf_dir, "route_dir").select("route_id", "direction_id", (500.0 * F.col("route_no") + 250 * F.col("direction_id")).alias("_y"))
    seq = F.row_number().over(Window.partitionBy("route_id", "direction_id").orderBy("d"))
    stops = t.view(spark, sf_dir, "stop").join(routes, ["route_id", "direction_id"]).select("route_id", "direction_id", seq.alias("seq"), F.col("d").alias("x"), (F.col("_y") + F.col("stop_id") % 40).alias("y"))
    return network.project_stops(stops, segments).withColumnRenamed("offset", "off_line")


# One way is a hairpin whose way back runs 20 m beside its way out, the other a circle; stops stand on either side.
BENT = """SELECT route_id, direction_id, {0} AS k, CASE WHEN direction_id = 1 THEN 800 * cos({1} / CAST(800 AS DOUBLE)) WHEN {1} <= 2500 THEN {1} ELSE 5000 - {1} END AS x,
  CASE WHEN direction_id = 1 THEN 800 * sin({1} / CAST(800 AS DOUBLE)) WHEN {1} <= 2500 THEN CAST(0 AS DOUBLE) ELSE CAST(20 AS DOUBLE) END + {2} AS y, {1} AS d FROM {3}"""
BENT_STOPS = BENT.format("CAST(row_number() OVER (PARTITION BY route_id, direction_id ORDER BY d) AS INT)", "d", "CAST(stop_id % 30 - 15 AS DOUBLE)", "{}")
BENT_LINE = BENT.format("CAST(seq AS INT)", "d", "CAST(0 AS DOUBLE)", "{}")
BENT_SEGMENTS = "SELECT * FROM (SELECT route_id, direction_id, k, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, d AS c0 FROM {} WINDOW w AS (PARTITION BY route_id, direction_id ORDER BY k)) AS s WHERE x1 IS NOT NULL"


@query(f"""SELECT route_id, direction_id, seq, d, off_line FROM (WITH RECURSIVE leg AS MATERIALIZED ({BENT_SEGMENTS.format("(" + BENT_LINE.format("shape_point") + ") AS p")}), halt AS MATERIALIZED ({BENT_STOPS.format("stop")}),
  walk AS (SELECT DISTINCT route_id, direction_id, 0 AS seq, 0 AS at, 0.0::DOUBLE AS d, 0.0::DOUBLE AS off_line FROM leg
    UNION ALL SELECT route_id, direction_id, seq, b.k, b.d, b.off FROM (SELECT w.route_id, w.direction_id, h.k AS seq, min({{'off': sqrt((x0 + u * (x1 - x0) - h.x) * (x0 + u * (x1 - x0) - h.x) + (y0 + u * (y1 - y0) - h.y) * (y0 + u * (y1 - y0) - h.y)), 'k': l.k, 'd': c0 + u * sqrt(len2)}}) AS b
      FROM walk AS w JOIN halt AS h ON h.route_id = w.route_id AND h.direction_id = w.direction_id AND h.k = w.seq + 1 JOIN (SELECT *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS len2 FROM leg) AS l ON l.route_id = w.route_id AND l.direction_id = w.direction_id AND l.k >= w.at,
        LATERAL (SELECT least(greatest(((h.x - x0) * (x1 - x0) + (h.y - y0) * (y1 - y0)) / len2, 0.0::DOUBLE), 1.0::DOUBLE) AS u) AS f GROUP BY 1, 2, 3) AS k)
  SELECT * FROM walk WHERE seq > 0) AS k""", ("d", "off_line"))  # fmt: skip
def project_stops_bent(spark, sf_dir):
    line = spark.sql(BENT_LINE.format("{p}").replace("'{p}'", "{p}"), p=points(spark, sf_dir))
    segments = spark.sql(BENT_SEGMENTS.format("{p}"), p=line)
    stops = spark.sql(BENT_STOPS.format("{s}"), s=t.view(spark, sf_dir, "stop")).withColumnRenamed("k", "seq")
    return network.project_stops(stops, segments).withColumnRenamed("offset", "off_line")
