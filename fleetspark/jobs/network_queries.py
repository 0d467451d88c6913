"""Queries over the schedule, map matching, signals and vehicle-days."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions import scalars
from fleetspark.jobs import tables as t
from fleetspark.jobs.registry import query
from fleetspark.operators import matching, network, signals, timelines
from fleetspark.sources import fixtures

ROUTES = "(SELECT DISTINCT o_orderpriority AS route_id, CAST(length(o_orderpriority) % 6 AS STRING) AS route_type FROM orders)"


def _routes(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("route_id"), (F.length("o_orderpriority") % 6).cast("string").alias("route_type")).distinct()


@query(f"SELECT trip_id, g.route_id FROM gtfs_trip AS g JOIN {ROUTES} AS r ON g.route_id = r.route_id WHERE service_id = 'O' AND route_type IN ('0', '3', '5') AND g.route_id <> '1-URGENT'")
def weekday_trips(spark, sf_dir):
    return network.weekday_trips(t.view(spark, sf_dir, "gtfs_trip"), _routes(spark, sf_dir), "O", skip=("1-URGENT",)).select("trip_id", "route_id")


RUNTIME = """(SELECT trip_id, CAST(min_by(s, stop_sequence) AS INT) AS start, CAST(max_by(s, stop_sequence) - min_by(s, stop_sequence) AS INT) AS runtime FROM (
  SELECT *, CAST(substr(departure, 1, 2) AS INT) * 3600 + CAST(substr(departure, 4, 2) AS INT) * 60 AS s FROM stop_time) AS k GROUP BY trip_id)"""
MODAL = """(SELECT route_id, direction_id, shape_id, n FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY n DESC, shape_id) AS k
  FROM (SELECT route_id, direction_id, shape_id, count(*) AS n FROM gtfs_trip GROUP BY ALL) AS c) AS c WHERE k = 1)"""


@query(f"SELECT * FROM {RUNTIME} AS r")
def trip_runtimes(spark, sf_dir):
    return network.trip_runtimes(t.view(spark, sf_dir, "stop_time"))


@query("SELECT stop_id, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes FROM stop_time JOIN gtfs_trip USING (trip_id) GROUP BY stop_id")
def stop_routes(spark, sf_dir):
    rows = network.stop_routes(t.view(spark, sf_dir, "stop_time"), t.view(spark, sf_dir, "gtfs_trip"))
    return rows.select("stop_id", F.concat_ws(",", "routes").alias("routes"))


@query(f"SELECT * FROM {MODAL} AS m")
def modal_shape(spark, sf_dir):
    return network.modal_shape(t.view(spark, sf_dir, "gtfs_trip"))


@query(f"""SELECT route_id, direction_id, pattern, n, trip_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY n DESC, trip_id) AS k FROM (
  SELECT route_id, direction_id, pattern, count(*) AS n, min(trip_id) AS trip_id FROM (
    SELECT g.route_id, g.direction_id, g.trip_id, string_agg(CAST(stop_id AS STRING), ',' ORDER BY stop_sequence) AS pattern
    FROM gtfs_trip AS g JOIN {MODAL} AS m ON g.route_id = m.route_id AND g.direction_id = m.direction_id AND g.shape_id = m.shape_id JOIN stop_time AS s ON s.trip_id = g.trip_id GROUP BY ALL) AS c GROUP BY ALL) AS c) AS c WHERE k = 1""")  # fmt: skip
def modal_pattern(spark, sf_dir):
    trips = t.view(spark, sf_dir, "gtfs_trip")
    return network.modal_pattern(trips, t.view(spark, sf_dir, "stop_time"), network.modal_shape(trips))


@query(f"""SELECT c.route_id, c.direction_id, s.stop_sequence, s.stop_id, CAST(s.s - min(s.s) OVER (PARTITION BY c.trip_id) AS INT) AS offset_s FROM (
  SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY n DESC, trip_id) AS k FROM (SELECT route_id, direction_id, pattern, count(*) AS n, min(trip_id) AS trip_id FROM (
    SELECT g.route_id, g.direction_id, g.trip_id, string_agg(CAST(stop_id AS STRING), ',' ORDER BY stop_sequence) AS pattern
    FROM gtfs_trip AS g JOIN {MODAL} AS m ON g.route_id = m.route_id AND g.direction_id = m.direction_id AND g.shape_id = m.shape_id JOIN stop_time AS s ON s.trip_id = g.trip_id GROUP BY ALL) AS c GROUP BY ALL) AS c) AS c
  JOIN (SELECT *, CAST(substr(departure, 1, 2) AS INT) * 3600 + CAST(substr(departure, 4, 2) AS INT) * 60 AS s FROM stop_time) AS s ON s.trip_id = c.trip_id WHERE c.k = 1""")  # fmt: skip
def pattern_offsets(spark, sf_dir):
    trips, times = t.view(spark, sf_dir, "gtfs_trip"), t.view(spark, sf_dir, "stop_time")
    return network.pattern_offsets(network.modal_pattern(trips, times, network.modal_shape(trips)), times)


@query(f"""SELECT route_id, direction_id, hour, n AS trips, runtime, headsign FROM (
  SELECT g.route_id, g.direction_id, CAST(floor(start / 3600) AS INT) AS hour, count(*) AS n, quantile_cont(runtime, 0.5) AS runtime FROM gtfs_trip AS g JOIN {MODAL} AS m USING (route_id, direction_id, shape_id) JOIN {RUNTIME} AS r USING (trip_id) GROUP BY ALL) AS a
  JOIN (SELECT route_id, direction_id, hour, headsign FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id, hour ORDER BY n DESC, headsign) AS k FROM (
    SELECT g.route_id, g.direction_id, CAST(floor(start / 3600) AS INT) AS hour, headsign, count(*) AS n FROM gtfs_trip AS g JOIN {MODAL} AS m USING (route_id, direction_id, shape_id) JOIN {RUNTIME} AS r USING (trip_id) GROUP BY ALL) AS c) AS c WHERE k = 1) AS b
  USING (route_id, direction_id, hour)""", ("runtime",))  # fmt: skip
def sched_by_hour(spark, sf_dir):
    return schedule(spark, sf_dir)


def schedule(spark, sf_dir):
    trips = t.view(spark, sf_dir, "gtfs_trip")
    return network.sched_by_hour(trips, t.view(spark, sf_dir, "stop_time"), network.modal_shape(trips))


def _vertices(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS shape_id", "s_suppkey AS seq", "cast(s_acctbal AS double) AS x", "cast(s_suppkey * 7 AS double) AS y")


POINTS = """SELECT shape_id, CAST(k AS INT) AS seq, k * 10.0::DOUBLE AS d, x + (k * 10 - c0) / l * (x1 - x) AS x, y + (k * 10 - c0) / l * (y1 - y) AS y FROM (
  SELECT *, unnest(range(CAST(ceil(c0 / 10) AS BIGINT), CAST(ceil(c1 / 10) AS BIGINT))) AS k FROM (
    SELECT *, c1 - l AS c0 FROM (SELECT *, sum(l) OVER (PARTITION BY shape_id ORDER BY seq) AS c1 FROM (
      SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS l FROM (
        SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM (SELECT s_nationkey AS shape_id, s_suppkey AS seq, CAST(s_acctbal AS DOUBLE) AS x, CAST(s_suppkey * 7 AS DOUBLE) AS y FROM supplier) AS v WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) AS k
      WHERE x1 IS NOT NULL) AS k) AS k) AS k) AS k"""


@query(f"""SELECT shape_id, seq, d, x, y, CASE WHEN turned >= 360 THEN turned - 360 ELSE turned END AS bearing FROM (
  SELECT *, degrees(atan2(coalesce(lead(x, 2) OVER w, last_value(x) OVER whole) - coalesce(lag(x, 2) OVER w, first_value(x) OVER whole),
    coalesce(lead(y, 2) OVER w, last_value(y) OVER whole) - coalesce(lag(y, 2) OVER w, first_value(y) OVER whole))) + 360.0::DOUBLE AS turned
  FROM ({POINTS}) AS p WINDOW w AS (PARTITION BY shape_id ORDER BY seq), whole AS (PARTITION BY shape_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS k""", ("d", "x", "y", "bearing"))  # fmt: skip
def densify_shape(spark, sf_dir):
    return network.densify_shape(_vertices(spark, sf_dir))


CANDIDATE = """(SELECT event_id, shape_id, b.along AS along, b.off AS off FROM (
  SELECT p.event_id, s.shape_id, min({'off': sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 'along': s.d}) AS b
  FROM ping AS p JOIN shape_point AS s ON p.mode = s.mode AND s.x BETWEEN p.x - 30 AND p.x + 30 AND s.y BETWEEN p.y - 30 AND p.y + 30
  WHERE sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) < 30
    AND (least(abs(p.heading - s.bearing), 360 - abs(p.heading - s.bearing)) <= 55 OR (p.average_speed = 0 AND p.heading = 0)) GROUP BY 1, 2) AS k)"""
SEGMENT = f"""(SELECT * FROM (SELECT *, max(along) OVER (PARTITION BY day, vehicle_id, trip, route_id, direction_id ORDER BY t) AS far FROM (
  SELECT p.day, p.vehicle_id, p.event_id, p.t, p.trip, p.route_id, p.direction_id, c.along, count(*) OVER (PARTITION BY p.day, p.vehicle_id, p.trip, p.route_id, p.direction_id) AS n
  FROM ping AS p JOIN route_dir AS r USING (route_id, direction_id) JOIN {CANDIDATE} AS c ON c.event_id = p.event_id AND c.shape_id = r.shape_id) AS k WHERE n >= 2) AS k WHERE along >= far - 120)"""
TRIMMED = f"""(SELECT day, vehicle_id, event_id, t, trip, route_id, direction_id, a AS along FROM (
  SELECT *, max(k) FILTER (WHERE a <= a0 + 30) OVER (PARTITION BY day, trip) AS dep, min(k) FILTER (WHERE a >= a1 - 30) OVER (PARTITION BY day, trip) AS arr FROM (
    SELECT *, min(a) OVER (PARTITION BY day, trip) AS a0, max(a) OVER (PARTITION BY day, trip) AS a1, row_number() OVER (PARTITION BY day, trip ORDER BY t) AS k FROM (
      SELECT *, max(along) OVER (PARTITION BY day, trip ORDER BY t) AS a FROM {SEGMENT} AS s) AS s) AS s) AS s WHERE arr > dep AND k BETWEEN dep AND arr)"""
ACCEPTED = f"""(SELECT * EXCLUDE (span, n) FROM (SELECT *, max(along) OVER (PARTITION BY day, trip) - min(along) OVER (PARTITION BY day, trip) AS span, count(*) OVER (PARTITION BY day, trip) AS n FROM {TRIMMED} AS s) AS s WHERE span >= 1500 AND n >= 6)"""


def candidates(spark, sf_dir, labelled=False):
    return matching.match_candidates(t.view(spark, sf_dir, "ping"), fixtures.shape_points(t.view(spark, sf_dir, "route_dir")), labelled=labelled)


def segments(spark, sf_dir):
    return matching.segment_labelled(t.view(spark, sf_dir, "ping"), candidates(spark, sf_dir, True), t.view(spark, sf_dir, "route_dir"))


def accepted(spark, sf_dir):
    return matching.accept_trips(matching.trim_layover(segments(spark, sf_dir)), t.view(spark, sf_dir, "route_dir"))


@query(f"SELECT * FROM {CANDIDATE} AS c", ("along", "off"))
def match_candidates(spark, sf_dir):
    return candidates(spark, sf_dir)


@query(f"SELECT event_id, trip, along FROM {SEGMENT} AS s", ("along",))
def segment_labelled(spark, sf_dir):
    return segments(spark, sf_dir).select("event_id", "trip", "along")


@query(f"SELECT event_id, trip, along FROM {TRIMMED} AS s", ("along",))
def trim_layover(spark, sf_dir):
    return matching.trim_layover(segments(spark, sf_dir)).select("event_id", "trip", "along")


@query(f"SELECT event_id, trip, along FROM {ACCEPTED} AS s", ("along",))
def accept_trips(spark, sf_dir):
    return accepted(spark, sf_dir).select("event_id", "trip", "along")


@query("SELECT DISTINCT day, trip, lead FROM lead_ping")
def lead_vehicle(spark, sf_dir):
    return matching.lead_vehicle(t.view(spark, sf_dir, "ping")).select("day", "trip", "lead").distinct()


VEHICLE_ROW = f"""(SELECT p.day, p.vehicle_id, p.event_id, p.t, coalesce(a.trip, 0) AS trip, concat(p.route_id, '_', p.direction_id) AS route_key, c.along AS route_along
  FROM ping AS p LEFT JOIN {ACCEPTED} AS a ON a.event_id = p.event_id LEFT JOIN route_dir AS r ON r.route_id = p.route_id AND r.direction_id = p.direction_id
  LEFT JOIN {CANDIDATE} AS c ON c.event_id = p.event_id AND c.shape_id = r.shape_id)"""


def vehicle_rows(spark, sf_dir):
    return matching.vehicle_pings(t.view(spark, sf_dir, "ping"), accepted(spark, sf_dir), candidates(spark, sf_dir, True), t.view(spark, sf_dir, "route_dir"))


@query(f"SELECT * FROM {VEHICLE_ROW} AS v", ("route_along",))
def vehicle_pings(spark, sf_dir):
    return vehicle_rows(spark, sf_dir).select("day", "vehicle_id", "event_id", "t", "trip", "route_key", "route_along")


@query(f"SELECT route_key, count(*) AS pings, count(*) FILTER (WHERE trip > 0) AS matched, count(DISTINCT trip) FILTER (WHERE trip > 0) AS trips, count(DISTINCT vehicle_id) AS vehicles FROM {VEHICLE_ROW} AS v GROUP BY 1")
def match_rate(spark, sf_dir):
    return matching.match_rate(vehicle_rows(spark, sf_dir))


@query(f"""SELECT 'mode' AS kind, CASE WHEN substr(route_key, 1, 2) = 'R3' THEN 'rail' ELSE 'bus' END AS name, count(DISTINCT trip) AS n FROM {VEHICLE_ROW} AS v WHERE trip > 0 GROUP BY 1, 2
  UNION ALL SELECT 'class', CASE WHEN vehicle_id <= 4 THEN 'motor' WHEN vehicle_id <= 9 THEN 'trolley' WHEN vehicle_id <= 49 THEN 'articulated' WHEN vehicle_id <= 99 THEN 'rail' ELSE 'other' END, count(DISTINCT vehicle_id) FROM {VEHICLE_ROW} AS v WHERE trip > 0 GROUP BY 1, 2""")
def match_totals(spark, sf_dir):
    mode = F.when(F.substring("route_key", 1, 2) == "R3", "rail").otherwise("bus")
    return matching.match_totals(vehicle_rows(spark, sf_dir).select("day", "vehicle_id", "trip", mode.alias("mode"), scalars.vehicle_class(F.col("vehicle_id")).alias("vclass")))


@query("""SELECT s.signal_id FROM signal AS s WHERE s.signal_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM signal AS r WHERE r.signal_id % 3 = 0 AND r.signal_id % 2 = s.signal_id % 2 AND sqrt((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y)) <= 60)""")
def local_only_stops(spark, sf_dir):
    points = t.view(spark, sf_dir, "signal").select(F.lit("f").alias("family"), (F.col("signal_id") % 2).cast("int").alias("direction_id"), F.col("signal_id").alias("stop_id"), "x", "y")
    return matching.local_only_stops(points.where("stop_id % 3 <> 0"), points.where("stop_id % 3 = 0")).select(F.col("stop_id").alias("signal_id"))


POSITION = """(SELECT route_id, direction_id, signal_id, b.d AS d FROM (
  SELECT p.route_id, p.direction_id, s.signal_id, min({'off': sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)), 'd': p.d}) AS b
  FROM signal AS s JOIN shape_point AS p ON p.x BETWEEN s.x - 20 AND s.x + 20 AND sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) < 20 GROUP BY 1, 2, 3) AS k WHERE b.d > 150 AND b.d < 4850 AND NOT (route_id <> 'R1' AND b.d BETWEEN 1000 AND 2000))"""


def tunnels(spark, sf_dir):
    """All routes but the second run underground from 1,000 to 2,000 m."""
    return t.view(spark, sf_dir, "route_dir").where("route_id <> 'R1'").select("route_id", "direction_id", F.lit(1000.0).alias("d0"), F.lit(2000.0).alias("d1"))


def positions(spark, sf_dir):
    routes = t.view(spark, sf_dir, "route_dir")
    return signals.signal_positions(t.view(spark, sf_dir, "signal"), fixtures.shape_points(routes), routes, tunnels=tunnels(spark, sf_dir))


@query(f"SELECT * FROM {POSITION} AS p", ("d",))
def signal_positions(spark, sf_dir):
    return positions(spark, sf_dir)


WAIT = f"""(SELECT p.route_id, p.direction_id, p.signal_id, p.d, passes, coalesce(wait, 0.0::DOUBLE) AS wait, coalesce(near_side, 0.0::DOUBLE) AS near_side FROM (
  SELECT p.route_id, p.direction_id, p.signal_id, p.d, count(*) AS passes FROM {POSITION} AS p JOIN extent AS e USING (route_id, direction_id) WHERE e.a0 <= p.d - 70 AND e.a1 >= p.d + 7 GROUP BY ALL) AS p LEFT JOIN (
  SELECT route_id, direction_id, f.signal_id AS signal_id, sum(CASE WHEN state IN (1, 3) THEN w ELSE 0.0::DOUBLE END) AS wait, sum(CASE WHEN state = 2 THEN w ELSE 0.0::DOUBLE END) AS near_side FROM (
    SELECT z.event_id, z.route_id, z.direction_id, z.along, z.state, z.w, min({{'d': p.d, 'signal_id': p.signal_id}}) AS f FROM state_ping AS z JOIN {POSITION} AS p USING (route_id, direction_id) WHERE p.d >= z.along - 12 GROUP BY ALL) AS z
  WHERE f.d - along <= 75 GROUP BY 1, 2, 3) AS w ON w.route_id = p.route_id AND w.direction_id = p.direction_id AND w.signal_id = p.signal_id)"""


def waits(spark, sf_dir):
    return signals.signal_waits(t.state_pings(spark, sf_dir), t.extents(spark, sf_dir), positions(spark, sf_dir))


@query(f"SELECT * FROM {WAIT} AS w", ("d", "wait", "near_side"))
def signal_waits(spark, sf_dir):
    return waits(spark, sf_dir)


@query(f"SELECT * FROM (SELECT signal_id, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY round(wait, 6) DESC, route_id, direction_id) AS INT) AS rank, route_id, direction_id, wait FROM {WAIT} AS w) AS k WHERE rank <= 8", ("wait",))
def signal_topk(spark, sf_dir):
    return signals.signal_topk(waits(spark, sf_dir))


TOTALS = f"""(SELECT * FROM (SELECT signal_id, sum(wait) / 3600.0::DOUBLE AS hours, sum(near_side) / 3600.0::DOUBLE AS near_hours, sum(passes)::DOUBLE AS passes, sum(wait) / sum(passes) AS wait,
  sum(CASE WHEN mode = 'bus' THEN wait ELSE 0.0::DOUBLE END) / 3600.0::DOUBLE AS bus_hours, sum(CASE WHEN mode = 'rail' THEN wait ELSE 0.0::DOUBLE END) / 3600.0::DOUBLE AS rail_hours
  FROM {WAIT} AS w JOIN route_dir AS r USING (route_id, direction_id) GROUP BY 1) AS k WHERE hours > 0)"""


def totals(spark, sf_dir):
    return signals.signal_totals(waits(spark, sf_dir), t.view(spark, sf_dir, "route_dir"))


@query(f"SELECT * FROM {TOTALS} AS s", ("hours", "near_hours", "passes", "wait", "bus_hours", "rail_hours"))
def signal_totals(spark, sf_dir):
    return totals(spark, sf_dir)


def _ranking(by: str, where: str) -> str:
    return f"""SELECT signal_id, CAST(row_number() OVER (ORDER BY round({by}, 6) DESC, signal_id) AS INT) AS rank, hours, wait, passes, (SELECT sum(hours) FROM (SELECT * FROM {TOTALS} AS s WHERE {where} ORDER BY round({by}, 6) DESC, signal_id LIMIT 20) AS k) / (SELECT sum(hours) FROM {TOTALS} AS s WHERE {where}) AS share
      FROM {TOTALS} AS s WHERE {where}"""


@query(_ranking("hours", "hours > 0.005::DOUBLE"), ("hours", "wait", "passes", "share"))
def signal_ranking(spark, sf_dir):
    return signals.signal_ranking(totals(spark, sf_dir))


# The derived trips are few: three passes are enough.
@query(_ranking("wait", "hours > 0.005::DOUBLE AND passes >= 3"), ("hours", "wait", "passes", "share"))
def signal_ranking_by_wait(spark, sf_dir):
    return signals.signal_ranking(totals(spark, sf_dir), by="wait", least_passes=3.0)


HOURS = f"""(SELECT z.signal_id, hour, sum(w) / 3600.0::DOUBLE AS hours FROM (
    SELECT z.event_id, z.route_id, z.direction_id, least(greatest(z.hour, 0), 23) AS hour, z.along, z.w, arg_min(p.signal_id, {{'d': p.d, 's': p.signal_id}}) AS signal_id, min(p.d) AS d FROM state_ping AS z JOIN {POSITION} AS p USING (route_id, direction_id)
    WHERE p.d >= z.along - 12 AND state IN (1, 3) GROUP BY ALL) AS z SEMI JOIN {WAIT} AS v ON v.route_id = z.route_id AND v.direction_id = z.direction_id AND v.signal_id = z.signal_id WHERE d - along <= 75 GROUP BY 1, 2)"""


@query(f"SELECT * FROM {HOURS} AS h", ("hours",))
def waits_by_hour(spark, sf_dir):
    found = positions(spark, sf_dir)
    return signals.signal_hours(t.state_pings(spark, sf_dir), found, waits(spark, sf_dir))


def _seen(hours: str, mine: str, more: str = "") -> str:
    return f"""(SELECT k.signal_id, {hours} AS hours, coalesce(own_wait / own_passes, 0.0::DOUBLE) AS wait, coalesce(own_passes, 0)::DOUBLE AS passes FROM (
      SELECT signal_id, sum(wait) AS whole, coalesce(sum(wait) FILTER (WHERE {mine}), 0.0::DOUBLE) AS own, sum(passes) FILTER (WHERE {mine} AND k <= 8) AS own_passes, sum(wait) FILTER (WHERE {mine} AND k <= 8) AS own_wait
      FROM (SELECT w.*, mode, row_number() OVER (PARTITION BY signal_id ORDER BY round(wait, 6) DESC, w.route_id, w.direction_id) AS k FROM {WAIT} AS w JOIN route_dir AS r USING (route_id, direction_id)) AS w GROUP BY 1) AS k {more} WHERE whole > 0)"""


def _at(hour: int) -> str:
    return f"LEFT JOIN {HOURS} AS h ON h.signal_id = k.signal_id AND h.hour = {hour}"


SHARED = "coalesce(h.hours, 0.0::DOUBLE) * own / whole"


def _seen_ranking(seen: str, by: str, where: str) -> str:
    return f"""SELECT signal_id, CAST(row_number() OVER (ORDER BY round({by}, 6) DESC, signal_id) AS INT) AS rank, hours, wait, passes, (SELECT sum(hours) FROM (SELECT * FROM {seen} AS s WHERE {where} ORDER BY round({by}, 6) DESC, signal_id LIMIT 20) AS k) / (SELECT sum(hours) FROM {seen} AS s WHERE {where}) AS share
      FROM {seen} AS s WHERE {where}"""


RANKED = ("hours", "wait", "passes", "share")


def seen(spark, sf_dir, mode, hour=None):
    hours = signals.signal_hours(t.state_pings(spark, sf_dir), positions(spark, sf_dir), waits(spark, sf_dir))
    return signals.signals_seen(waits(spark, sf_dir), hours, t.view(spark, sf_dir, "route_dir"), mode, hour)


@query(_seen_ranking(_seen("own / 3600.0::DOUBLE", "mode = 'rail'"), "hours", "hours > 0.005::DOUBLE"), RANKED)
def signal_ranking_rail(spark, sf_dir):
    return signals.signal_ranking(seen(spark, sf_dir, "rail"))


@query(_seen_ranking(_seen(SHARED, "mode = 'bus'", _at(8)), "wait", "hours > 0.0005::DOUBLE AND passes >= 3"), RANKED)
def signal_ranking_bus_at_8(spark, sf_dir):
    """Buses from eight to nine, by their mean wait; the derived waits of one hour are short."""
    return signals.signal_ranking(seen(spark, sf_dir, "bus", 8), by="wait", least_passes=3.0, least_hours=0.0005)


@query(_seen_ranking(_seen(SHARED, "true", _at(17)), "hours", "hours > 0.0005::DOUBLE"), RANKED)
def signal_ranking_at_17(spark, sf_dir):
    return signals.signal_ranking(seen(spark, sf_dir, None, 17), least_hours=0.0005)


@query(f"SELECT route_id, direction_id, signal_id, " + " + ".join(f"(wait / passes >= {e})::INT" for e in scalars.WAIT_EDGES) + f" AS wait_class FROM {WAIT} AS w")
def wait_class(spark, sf_dir):
    return waits(spark, sf_dir).select("route_id", "direction_id", "signal_id", scalars.class_by_edges(F.col("wait") / F.col("passes"), scalars.WAIT_EDGES).alias("wait_class"))


CODED = """(SELECT *, CAST(CASE WHEN trip > 0 THEN state WHEN average_speed < 3 AND gap < 2700 THEN 4 WHEN average_speed < 3 THEN 6 ELSE 5 END AS INT) AS code FROM (
  SELECT *, min(CASE WHEN trip > 0 THEN t END) OVER (PARTITION BY day, vehicle_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    - max(CASE WHEN trip > 0 THEN t END) OVER (PARTITION BY day, vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap FROM (
    SELECT p.day, p.vehicle_id, p.event_id, p.t, p.average_speed, CASE WHEN p.run_no % 3 = 1 THEN 0 ELSE coalesce(z.trip, 0) END AS trip, z.state,
      CASE WHEN p.run_no % 3 <> 1 AND z.trip IS NOT NULL THEN concat(p.route_id, '_', p.direction_id) ELSE '' END AS label
    FROM ping AS p LEFT JOIN state_ping AS z ON z.event_id = p.event_id) AS k) AS k)"""


def coded(spark, sf_dir):
    """Every third run counts as out of service."""
    own = t.state_pings(spark, sf_dir).select("event_id", F.col("trip").alias("_trip"), "state")
    rows = t.view(spark, sf_dir, "ping").join(own, "event_id", "left")
    out = F.col("run_no") % 3 == 1
    rows = rows.withColumn("trip", F.when(out, 0).otherwise(F.coalesce("_trip", F.lit(0))))
    label = F.when(~out & F.col("_trip").isNotNull(), F.concat_ws("_", "route_id", "direction_id")).otherwise("")
    return timelines.activity_codes(rows.select("day", "vehicle_id", "event_id", "t", "average_speed", "trip", "state", label.alias("label")))


@query(f"SELECT event_id, code FROM {CODED} AS c")
def activity_codes(spark, sf_dir):
    return coded(spark, sf_dir).select("event_id", "code")


TIMELINE = f"""(SELECT day, vehicle_id, unnest(CASE WHEN alone THEN [{{'t0': t0, 't1': t0 + 30, 'code': code, 'label': label}}, {{'t0': t0 + 30, 't1': t1, 'code': 7, 'label': ''}}] ELSE [{{'t0': t0, 't1': t1, 'code': code, 'label': label}}] END) AS s FROM (
  SELECT day, vehicle_id, island, min(t) AS t0, max(t1) AS t1, min(code) AS code, min(label) AS label, bool_or(alone) AS alone FROM (
    SELECT *, sum(brk) OVER (PARTITION BY day, vehicle_id ORDER BY t) AS island FROM (
      SELECT *, CASE WHEN lag(code) OVER w = code AND lag(label) OVER w = label AND NOT lag(alone) OVER w AND NOT alone THEN 0 ELSE 1 END AS brk FROM (
        SELECT *, t1 - t > 600 AS alone FROM (SELECT *, coalesce(lead(t) OVER (PARTITION BY day, vehicle_id ORDER BY t), t + 30) AS t1 FROM {CODED} AS c) AS c) AS c
      WINDOW w AS (PARTITION BY day, vehicle_id ORDER BY t)) AS c) AS c GROUP BY 1, 2, 3) AS c)"""


@query(f"SELECT day, vehicle_id, s.t0 AS t0, s.t1 AS t1, CAST(s.code AS INT) AS code, s.label AS label FROM {TIMELINE} AS x")
def timeline_segments(spark, sf_dir):
    return timelines.timeline_segments(coded(spark, sf_dir))


def summaries(spark, sf_dir):
    rows = coded(spark, sf_dir)
    return timelines.vehicle_day_summary(timelines.timeline_segments(rows), rows.where("trip > 0").select("day", "vehicle_id").distinct())


HOURS = ", ".join(f"sum(CASE WHEN s.code = {k} THEN s.t1 - s.t0 ELSE 0 END) / 3600.0::DOUBLE AS h{k}" for k in range(8))
SUMMARY = f"""(SELECT h.*, coalesce(routes, '') AS routes FROM (SELECT day, vehicle_id, {HOURS} FROM {TIMELINE} AS x GROUP BY 1, 2) AS h
  SEMI JOIN (SELECT DISTINCT vehicle_id FROM {CODED} AS c WHERE trip > 0) AS v ON v.vehicle_id = h.vehicle_id
  LEFT JOIN (SELECT vehicle_id, string_agg(route, ',' ORDER BY k) AS routes FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC, route) AS k FROM (
    SELECT vehicle_id, split_part(s.label, '_', 1) AS route, count(*) AS n FROM {TIMELINE} AS x WHERE s.label <> '' GROUP BY 1, 2) AS c) AS c WHERE k <= 3 GROUP BY 1) AS r ON r.vehicle_id = h.vehicle_id)"""


@query(f"SELECT * FROM {SUMMARY} AS s", tuple(f"h{k}" for k in range(8)))
def vehicle_day_summary(spark, sf_dir):
    return summaries(spark, sf_dir)


@query(f"""SELECT day, vehicle_id, stuck, service FROM (SELECT day, vehicle_id, CASE WHEN h0 + h1 + h2 + h3 > 0 THEN (h1 + h2 + h3) / (h0 + h1 + h2 + h3) ELSE 0 END::DOUBLE AS stuck, h0 + h1 + h2 + h3 AS service FROM {SUMMARY} AS s) AS k
  ORDER BY round(stuck, 9) DESC, vehicle_id LIMIT 250""", ("stuck", "service"))  # fmt: skip
def fleet_day_totals(spark, sf_dir):
    return timelines.fleet_day_totals(summaries(spark, sf_dir))


@query(f"""SELECT day, vehicle_id, service, layover FROM (SELECT day, vehicle_id, h0 + h1 + h2 + h3 AS service, h4 AS layover FROM {SUMMARY} AS s) AS k ORDER BY round(service, 6) DESC, day, vehicle_id LIMIT 250""", ("service", "layover"))
def fleet_by_service(spark, sf_dir):
    return timelines.fleet_ranking(summaries(spark, sf_dir), "service")


@query(f"""SELECT day, vehicle_id, service, layover FROM (SELECT day, vehicle_id, h0 + h1 + h2 + h3 AS service, h4 AS layover FROM {SUMMARY} AS s) AS k ORDER BY round(layover, 6) DESC, day, vehicle_id LIMIT 250""", ("service", "layover"))
def fleet_by_layover(spark, sf_dir):
    return timelines.fleet_ranking(summaries(spark, sf_dir), "layover")


@query(f"""SELECT code, hours, hours / sum(hours) OVER () AS share FROM (SELECT CAST(unnest(range(6)) AS INT) AS code, unnest([sum(h0), sum(h1), sum(h2), sum(h3), sum(h4), sum(h5)]) AS hours FROM {SUMMARY} AS s) AS k""", ("hours", "share"))
def fleet_code_hours(spark, sf_dir):
    return timelines.fleet_code_hours(summaries(spark, sf_dir))


# Of pings (event_id, day, vehicle_id, t, x, y, average_speed) in ``shown``.
THIN = """WITH RECURSIVE shown AS MATERIALIZED ({}), fresh AS MATERIALIZED (
    SELECT * EXCLUDE (stale) FROM (SELECT *, coalesce(lag(x) OVER w = x AND lag(y) OVER w = y AND average_speed > 2, false) AS stale FROM shown WINDOW w AS (PARTITION BY day, vehicle_id ORDER BY t)) AS k WHERE NOT stale),
  after AS MATERIALIZED (SELECT a.vehicle_id, a.t, min(b.t) AS t1 FROM fresh AS a JOIN fresh AS b ON a.vehicle_id = b.vehicle_id AND b.t >= a.t + 20 GROUP BY 1, 2),
  kept AS (SELECT vehicle_id, min(t) AS t FROM fresh GROUP BY 1 UNION ALL SELECT k.vehicle_id, a.t1 AS t FROM kept AS k JOIN after AS a ON a.vehicle_id = k.vehicle_id AND a.t = k.t),
  thinned AS (SELECT f.* FROM fresh AS f JOIN kept AS k USING (vehicle_id, t))"""


@query("SELECT event_id, vehicle_id, t FROM (" + THIN.format(f"SELECT c.*, p.x, p.y FROM {CODED} AS c JOIN ping AS p USING (event_id) WHERE c.code <> 6") + " SELECT * FROM thinned) AS k")
def thin_positions(spark, sf_dir):
    places = t.view(spark, sf_dir, "ping").select("event_id", "x", "y")
    return timelines.thin_positions(coded(spark, sf_dir).join(places, "event_id")).select("event_id", "vehicle_id", "t")


PLAYED = "(" + THIN.format(f"""SELECT c.event_id, c.day, c.vehicle_id, c.t, c.average_speed, c.code, p.x, p.y, p.mode,
      CASE WHEN c.label <> '' THEN c.label WHEN r.along IS NOT NULL AND c.trip = 0 THEN concat(p.route_id, '_', p.direction_id) ELSE '' END AS label, CAST(round_even(CASE WHEN c.trip > 0 THEN p.along ELSE coalesce(r.along, -1.0::DOUBLE) END, 0) AS INT) AS along
    FROM {CODED} AS c JOIN ping AS p USING (event_id) LEFT JOIN (SELECT k.event_id, k.along, d.route_id, d.direction_id FROM {CANDIDATE} AS k JOIN route_dir AS d USING (shape_id)) AS r ON r.event_id = c.event_id AND r.route_id = p.route_id AND r.direction_id = p.direction_id
    WHERE c.code <> 6 AND c.vehicle_id IN (SELECT vehicle_id FROM {CODED} AS o WHERE trip > 0)""") + " SELECT * FROM thinned)"


def played(spark, sf_dir):
    places = t.view(spark, sf_dir, "ping").select("event_id", "x", "y", "mode", F.col("along").alias("_along"))
    on_route = vehicle_rows(spark, sf_dir).select("event_id", "route_key", "route_along")
    rows = coded(spark, sf_dir).join(places, "event_id").join(on_route, "event_id", "left")
    return timelines.playback_positions(rows.withColumn("along", F.when(F.col("trip") > 0, F.col("_along"))).withColumnRenamed("mode", "vclass"))


@query(f"""SELECT event_id, hour, mode, CAST(round_even((x / (111320.0::DOUBLE * cos(radians(37.76::DOUBLE))) - 122.44::DOUBLE) * 100000, 0) AS BIGINT) AS lon5, CAST(round_even((y / 110540.0::DOUBLE + 37.76::DOUBLE) * 100000, 0) AS BIGINT) AS lat5,
    coalesce(l.no, 0)::INT AS label_no, along, average_speed AS mph
  FROM (SELECT c.*, unnest(range(CAST(floor((c.t - 1200) / 3600) AS INT), CAST(floor((c.t + 1200) / 3600) AS INT) + 1))::INT AS hour FROM {PLAYED} AS c) AS c
  LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) AS no FROM (SELECT DISTINCT label FROM {PLAYED} AS c WHERE label <> '') AS k) AS l ON l.label = c.label WHERE hour BETWEEN 0 AND 24""")  # fmt: skip
def tile_rows(spark, sf_dir):
    """Rows of the tile documents, taken out of them again."""
    documents = timelines.tile_documents(timelines.hourly_tiles(played(spark, sf_dir)), ("event_id",))
    return documents.select("hour", "mode", F.explode("rows").alias("r")).select("r.event_id", "hour", "mode", "r.lon5", "r.lat5", "r.label_no", "r.along", "r.mph")


@query(f"SELECT event_id, hour FROM (SELECT event_id, unnest(range(CAST(floor((t - 1200) / 3600) AS INT), CAST(floor((t + 1200) / 3600) AS INT) + 1))::INT AS hour FROM {PLAYED} AS p) AS k WHERE hour BETWEEN 0 AND 24")
def hourly_tiles(spark, sf_dir):
    return timelines.hourly_tiles(played(spark, sf_dir)).select("event_id", "hour")
