"""Statements that recompute the jobs' tables in plain SQL, to check them against.

Each is a view over the driver's tables or over views before it; ``statement``
puts together the ones that a final select needs.
"""

from __future__ import annotations

import re

from fleetspark.sources import fixtures

VIEWS = dict(fixtures.VIEWS)
VIEWS |= {
    "shape_point": """
      SELECT route_id, direction_id, mode, shape_id, seq, CAST(seq * 10 AS DOUBLE) AS x, CAST(500 * route_no + 250 * direction_id AS DOUBLE) AS y,
        CAST(seq * 10 AS DOUBLE) AS d, CAST(90 AS DOUBLE) AS bearing
      FROM route_dir, (SELECT unnest(range(500))::INT AS seq) AS s""",
    "lead_ping": """
      SELECT p.*, f.lead FROM ping AS p JOIN (
        SELECT day, trip, row_number() OVER (PARTITION BY day, gtfs_trip_id ORDER BY n DESC, trip) = 1 AS lead
        FROM (SELECT day, trip, min(gtfs_trip_id) AS gtfs_trip_id, count(*) AS n FROM ping GROUP BY 1, 2) AS c) AS f USING (day, trip)""",
    "run_ping": """
      SELECT *, sum(CASE WHEN step <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY trip ORDER BY t) AS run
      FROM (SELECT *, along - lag(along) OVER (PARTITION BY trip ORDER BY t) AS step FROM lead_ping WHERE lead) AS k""",
    "moving_ping": """
      SELECT * EXCLUDE (step, run, t0, t1) FROM (SELECT *, min(t) OVER (PARTITION BY trip, run) AS t0, max(t) OVER (PARTITION BY trip, run) AS t1 FROM run_ping) AS k
      WHERE NOT (t > t0 AND t < t1 AND t1 - t0 >= 300)""",
    "state_ping": """
      SELECT *, CASE WHEN average_speed >= 5 THEN 0 WHEN average_speed > 0 THEN 1 WHEN in_zone THEN 2 ELSE 3 END::INT AS state,
        CAST(floor(t / 3600) AS INT) AS hour, CAST(floor(along / 100) AS INT) AS bin
      FROM (SELECT *, (least(coalesce(t - lag(t) OVER w, 0), 180) + least(coalesce(lead(t) OVER w - t, 0), 180)) / 2.0::DOUBLE AS w,
          EXISTS (SELECT 1 FROM stop AS s WHERE s.route_id = m.route_id AND s.direction_id = m.direction_id AND s.d >= m.along - 30 AND s.d < m.along + 40) AS in_zone
        FROM moving_ping AS m WINDOW w AS (PARTITION BY trip ORDER BY t)) AS k""",
    "bin_part": """
      SELECT route_id, direction_id, mode, day, trip, bin, CAST(floor((t + t1) / 2.0::DOUBLE / 3600) AS INT) AS hour,
        dt * CASE WHEN dd > 0.5::DOUBLE THEN piece / dd WHEN bin = b0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS time, CASE WHEN dd > 0.5::DOUBLE THEN piece ELSE 0.0::DOUBLE END AS dist
      FROM (SELECT *, greatest(least(greatest(a1, along), (bin + 1) * 100.0::DOUBLE) - greatest(along, bin * 100.0::DOUBLE), 0.0::DOUBLE) AS piece
        FROM (SELECT *, unnest(range(b0, b1 + 1))::INT AS bin
          FROM (SELECT *, CAST(t1 - t AS DOUBLE) AS dt, greatest(a1 - along, 0.0::DOUBLE) AS dd, CAST(floor(along / 100) AS INT) AS b0,
              CAST(floor(greatest(a1 - 0.000001::DOUBLE, along) / 100.0::DOUBLE) AS INT) AS b1
            FROM (SELECT *, lead(t) OVER (PARTITION BY trip ORDER BY t) AS t1, lead(along) OVER (PARTITION BY trip ORDER BY t) AS a1 FROM moving_ping) AS k
            WHERE t1 > t AND t1 - t <= 180) AS k) AS k) AS k""",
    "extent": """
      SELECT e.*, r.length, r.mode, (a1 - a0) / length AS cov FROM (
        SELECT day, trip, min_by(route_id, t) AS route_id, min_by(direction_id, t) AS direction_id, min_by(vehicle_id, t) AS vehicle_id, min(t) AS t0, max(t) AS t1,
          min(along) AS a0, max(along) AS a1, count(*) AS n FROM moving_ping GROUP BY day, trip) AS e JOIN route_dir AS r USING (route_id, direction_id)""",
    "grid": """
      SELECT *, CASE WHEN time > 0 THEN dist / time END AS speed FROM (
        SELECT route_id, direction_id, bin, hour, mode, sum(time) AS time, sum(dist) AS dist, count(DISTINCT trip) AS trips
        FROM bin_part WHERE hour BETWEEN 5 AND 23 GROUP BY ALL) AS k""",
    "reference": """
      SELECT route_id, direction_id, bin, least(greatest(p, 8.0::DOUBLE / 2.23694::DOUBLE), CASE WHEN mode = 'rail' THEN 50.0::DOUBLE ELSE 30.0::DOUBLE END / 2.23694::DOUBLE) AS vref
      FROM (SELECT route_id, direction_id, bin, mode, quantile_cont(speed, 0.9) AS p FROM grid WHERE trips >= 1 AND speed IS NOT NULL GROUP BY ALL) AS k""",
    "delay": """
      SELECT *, CASE WHEN vref IS NOT NULL THEN greatest(time - dist / vref, 0.0::DOUBLE) END AS delay FROM grid LEFT JOIN reference USING (route_id, direction_id, bin)""",
    "heat": """
      SELECT d.route_id, d.direction_id, bin, hour, speed * 2.23694::DOUBLE AS mph, trips, delay / trips AS delay_per_trip
      FROM delay AS d JOIN route_dir AS r USING (route_id, direction_id) WHERE trips >= 1 AND time > 0 AND bin < ceil(length / 100)""",
    "traversal": """
      SELECT route_id, direction_id, bin, count(*) AS traversals FROM (
        SELECT route_id, direction_id, unnest(range(CAST(floor(a0 / 100) AS INT), CAST(least(floor(a1 / 100), ceil(length / 100)) AS INT) + 1))::INT AS bin FROM extent) AS k GROUP BY ALL""",
    "fleet_hours": """
      SELECT CASE WHEN grouping(mode) = 1 THEN 'all' ELSE mode END AS mode, hour, STATE_SUMS_3600 FROM state_ping WHERE hour BETWEEN 0 AND 24 GROUP BY GROUPING SETS ((mode, hour), (hour))""",
    "dwell": """
      SELECT s.route_id, s.direction_id, s.stop_id, s.d, CASE WHEN middle THEN halts::DOUBLE / n END AS p, CASE WHEN middle THEN sec / n END AS stopped FROM (
        SELECT s.*, s.d NOT IN (min(s.d) OVER w, max(s.d) OVER w) AND n > 0 AS middle, coalesce(halts, 0) AS halts, coalesce(sec, 0.0::DOUBLE) AS sec
        FROM (SELECT s.*, (SELECT count(*) FROM extent AS e WHERE e.route_id = s.route_id AND e.direction_id = s.direction_id AND e.a0 <= s.d - 35 AND e.a1 >= s.d + 25) AS n FROM stop AS s) AS s
        LEFT JOIN (SELECT s.route_id, s.direction_id, s.stop_id, count(DISTINCT z.trip) AS halts, sum(z.w) AS sec FROM stop AS s JOIN state_ping AS z USING (route_id, direction_id)
          JOIN extent AS e ON e.trip = z.trip AND e.a0 <= s.d - 35 AND e.a1 >= s.d + 25
          WHERE z.average_speed = 0 AND z.along BETWEEN s.d - 40 AND s.d + 30 GROUP BY ALL) AS h ON h.route_id = s.route_id AND h.direction_id = s.direction_id AND h.stop_id = s.stop_id
        WINDOW w AS (PARTITION BY s.route_id, s.direction_id)) AS s""",
}
STATE_SUMS = ", ".join(f"coalesce(sum(w) FILTER (WHERE state = {k}), 0.0::DOUBLE) AS s{k}" for k in range(4))
VIEWS = {k: v.replace("STATE_SUMS_3600", ", ".join(f"coalesce(sum(w) FILTER (WHERE state = {k}), 0.0::DOUBLE) / 3600.0::DOUBLE AS s{k}" for k in range(4))) for k, v in VIEWS.items()}


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b(FROM|JOIN|,) {name}\b(?!\.)", text):
            for inner in _needed(VIEWS[name], seen):
                if inner not in seen:
                    seen.append(inner)
            if name not in seen:
                seen.append(name)
    return seen


def statement(select: str, doubles: tuple[str, ...] = ()) -> str:
    """One statement for ``select`` with the views it uses; ``doubles`` are rounded to six places."""
    names = _needed(select, [])
    names = [n for n in VIEWS if n in names]
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    rounded = ", ".join(f"round({c} + 0.000000001::DOUBLE, 6) + 0.0 AS {c}" for c in doubles)
    body = f"SELECT * REPLACE ({rounded}) FROM ({select}) AS result" if doubles else select
    return (f"WITH {views}\n" if views else "") + body
