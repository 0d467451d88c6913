"""Queries over pings and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.jobs import tables as t
from fleetspark.jobs.registry import query
from fleetspark.operators import states


@query("SELECT day, trip, event_id, t, along, lead FROM lead_ping WHERE lead", ("along",))
def global_trips(spark, sf_dir):
    return t.lead_pings(spark, sf_dir).select("day", "trip", "event_id", "t", "along", "lead")


@query("SELECT day, trip, event_id, t, along FROM moving_ping", ("along",))
def drop_layovers(spark, sf_dir):
    return t.moving_pings(spark, sf_dir).select("day", "trip", "event_id", "t", "along")


@query("SELECT event_id, w FROM state_ping", ("w",))
def ping_weights(spark, sf_dir):
    return states.ping_weights(t.moving_pings(spark, sf_dir)).select("event_id", "w")


@query("SELECT event_id, in_zone FROM state_ping")
def stop_zone_flag(spark, sf_dir):
    return states.stop_zone_flag(t.moving_pings(spark, sf_dir), t.view(spark, sf_dir, "stop")).select("event_id", "in_zone")


@query("SELECT event_id, trip, t, state, w, hour, bin FROM state_ping", ("w",))
def ping_states(spark, sf_dir):
    return t.state_pings(spark, sf_dir).select("event_id", "trip", "t", "state", "w", "hour", "bin")


@query("SELECT * FROM bin_part", ("time", "dist"))
def interval_bins(spark, sf_dir):
    return states.interval_bins(t.moving_pings(spark, sf_dir))


@query("SELECT * FROM extent", ("a0", "a1", "length", "cov"))
def trip_extents(spark, sf_dir):
    return t.extents(spark, sf_dir)


@query("""SELECT event_id, vehicle_id, t, x, y FROM (SELECT *, coalesce(lag(x) OVER w = x AND lag(y) OVER w = y AND average_speed > 2, false) AS stale
  FROM ping WINDOW w AS (PARTITION BY day, vehicle_id ORDER BY t)) AS k WHERE NOT stale""", ("x", "y"))  # fmt: skip
def stale_repeats(spark, sf_dir):
    return states.stale_repeats(t.view(spark, sf_dir, "ping")).select("event_id", "vehicle_id", "t", "x", "y")


PASSAGE = """SELECT route_id, direction_id, day, trip, d AS target, CASE WHEN p.along = d THEN p.t ELSE p.t + (q.t - p.t) * ((d - p.along) / (q.along - p.along)) END::DOUBLE AS t_at FROM (
  SELECT m.route_id, m.direction_id, m.day, m.trip, s.d, max({'along': along, 't': t}) FILTER (WHERE along <= d) AS p, min({'along': along, 't': t}) FILTER (WHERE along > d) AS q
  FROM moving_ping AS m JOIN stop AS s USING (route_id, direction_id) GROUP BY ALL) AS k WHERE p IS NOT NULL AND (q IS NOT NULL OR p.along = d)"""


def passages(spark, sf_dir):
    targets = t.view(spark, sf_dir, "stop").select("route_id", "direction_id", F.col("d").alias("target"))
    return states.position_interp(t.moving_pings(spark, sf_dir), targets)


@query(PASSAGE, ("target", "t_at"))
def position_interp(spark, sf_dir):
    return passages(spark, sf_dir)


@query(f"""SELECT point, hour, n, mean_gap, sq / (2 * mean_gap) AS wait FROM (
  SELECT point, CAST(floor(t_at / 3600) AS INT) AS hour, count(*) AS n, avg(h) AS mean_gap, avg(h * h) AS sq
  FROM (SELECT *, lead(t_at) OVER (PARTITION BY day, point ORDER BY t_at) - t_at AS h FROM (SELECT day, concat(route_id, '_', direction_id, '_', CAST(target AS INT)) AS point, t_at FROM ({PASSAGE}) AS k) AS k) AS k
  WHERE h < 20000 GROUP BY 1, 2) AS k WHERE n >= 2""", ("mean_gap", "wait"))  # fmt: skip
def headways(spark, sf_dir):
    point = F.concat_ws("_", "route_id", "direction_id", F.col("target").cast("int"))
    return states.headways(passages(spark, sf_dir).select("day", point.alias("point"), "t_at"), longest=20_000.0, least=2)
