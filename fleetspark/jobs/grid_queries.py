"""Queries over speed, delay and time budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions import scalars
from fleetspark.jobs import network_queries as n_
from fleetspark.jobs import tables as t
from fleetspark.jobs.checks import STATE_SUMS
from fleetspark.jobs.registry import query
from fleetspark.operators import grid
from fleetspark.sources import fixtures


@query("SELECT * FROM grid", ("time", "dist", "speed"))
def speed_grid(spark, sf_dir):
    return t.speed_grid(spark, sf_dir)


@query("SELECT * FROM reference", ("vref",))
def reference_speed(spark, sf_dir):
    return grid.reference_speed(t.speed_grid(spark, sf_dir), t.SPARSE)


@query("SELECT * FROM delay", ("time", "dist", "speed", "vref", "delay"))
def delay_grid(spark, sf_dir):
    return t.delays(spark, sf_dir)


@query("SELECT * FROM heat", ("mph", "delay_per_trip"))
def heat_cells(spark, sf_dir):
    return t.heat(spark, sf_dir)


@query("SELECT * FROM traversal")
def bin_traversals(spark, sf_dir):
    return t.traversals(spark, sf_dir)


@query(f"""SELECT route_id, direction_id, bin, s0 / traversals AS s0, s1 / traversals AS s1, s2 / traversals AS s2, s3 / traversals AS s3
  FROM (SELECT route_id, direction_id, bin, {STATE_SUMS} FROM state_ping GROUP BY ALL) AS k JOIN traversal USING (route_id, direction_id, bin)""", ("s0", "s1", "s2", "s3"))  # fmt: skip
def budget_by_bin(spark, sf_dir):
    return grid.budget_by_bin(t.state_pings(spark, sf_dir), t.traversals(spark, sf_dir))


@query(f"""SELECT route_id, direction_id, hour, s0 / total AS s0, s1 / total AS s1, s2 / total AS s2, s3 / total AS s3
  FROM (SELECT *, s0 + s1 + s2 + s3 AS total FROM (SELECT route_id, direction_id, hour, {STATE_SUMS} FROM state_ping WHERE hour BETWEEN 5 AND 23 GROUP BY ALL) AS k) AS k WHERE total > 0""", ("s0", "s1", "s2", "s3"))  # fmt: skip
def budget_by_hour(spark, sf_dir):
    return grid.budget_by_hour(t.state_pings(spark, sf_dir))


@query("""SELECT route_id, direction_id, hour, quantile_cont(minutes, 0.5) AS median, quantile_cont(minutes, 0.9) AS p90, count(*) AS n
  FROM (SELECT *, CAST(floor(t0 / 3600) AS INT) AS hour, (t1 - t0) / 60.0::DOUBLE / cov AS minutes FROM extent WHERE cov >= 0.3::DOUBLE) AS k
  WHERE hour BETWEEN 5 AND 23 GROUP BY ALL HAVING count(*) >= 2""", ("median", "p90"))  # fmt: skip
def runtime_by_hour(spark, sf_dir):
    return grid.runtime_by_hour(t.extents(spark, sf_dir), t.SPARSE)


RUNTIMES = """(SELECT route_id, direction_id, hour, quantile_cont(minutes, 0.5) AS median, quantile_cont(minutes, 0.9) AS p90, count(*) AS n
  FROM (SELECT *, CAST(floor(t0 / 3600) AS INT) AS hour, (t1 - t0) / 60.0::DOUBLE / cov AS minutes FROM extent WHERE cov >= 0.3::DOUBLE) AS k
  WHERE hour BETWEEN 5 AND 23 GROUP BY ALL HAVING count(*) >= 2)"""
PLANNED = "concat('R', CAST(substr(route_id, 1, 1) AS INT) - 1)"


@query(f"""SELECT coalesce(o.route_id, p.route_id) AS route_id, coalesce(o.direction_id, p.direction_id) AS direction_id, coalesce(o.hour, p.hour) AS hour, median, p90, n, planned FROM {RUNTIMES} AS o FULL JOIN (
    SELECT {PLANNED} AS route_id, g.direction_id, CAST(floor(start / 3600) AS INT) AS hour, quantile_cont(runtime, 0.5) / 60.0::DOUBLE AS planned FROM gtfs_trip AS g JOIN {n_.MODAL} AS m USING (route_id, direction_id, shape_id) JOIN {n_.RUNTIME} AS r USING (trip_id) GROUP BY 1, 2, 3) AS p
  ON p.route_id = o.route_id AND p.direction_id = o.direction_id AND p.hour = o.hour""", ("median", "p90", "planned"))  # fmt: skip
def runtime_beside_schedule(spark, sf_dir):
    """The schedule's five routes take the names R0 to R4."""
    planned = n_.schedule(spark, sf_dir).withColumn("route_id", F.expr(PLANNED))
    return grid.runtime_beside_schedule(grid.runtime_by_hour(t.extents(spark, sf_dir), t.SPARSE), planned)


@query("SELECT * FROM dwell", ("d", "p", "stopped"))
def stop_dwell(spark, sf_dir):
    return grid.stop_dwell(t.state_pings(spark, sf_dir), t.extents(spark, sf_dir), t.view(spark, sf_dir, "stop"))


@query("SELECT * FROM fleet_hours", ("s0", "s1", "s2", "s3"))
def fleet_budget(spark, sf_dir):
    return grid.fleet_budget(t.state_pings(spark, sf_dir))


@query("""SELECT route_id, direction_id, trips, mode, length, shape_id, trips / 1.0::DOUBLE AS trips_per_day
  FROM (SELECT route_id, direction_id, count(*) AS trips FROM extent GROUP BY ALL HAVING count(*) >= 3) AS k JOIN route_dir USING (route_id, direction_id)""", ("length", "trips_per_day"))  # fmt: skip
def observed_routes(spark, sf_dir):
    return grid.observed_routes(t.extents(spark, sf_dir), t.view(spark, sf_dir, "route_dir"))


CLASS = "CASE WHEN mph IS NOT NULL THEN " + " + ".join(f"(mph >= {e})::INT" for e in scalars.SPEED_EDGES) + " END"


@query(f"""SELECT route_id, direction_id, hour, min(bin) AS bin0, max(bin) AS bin1, count(*) AS bins, avg(mph) AS mph FROM (
    SELECT *, sum(brk) OVER (PARTITION BY route_id, direction_id, hour ORDER BY bin) AS island FROM (
      SELECT *, CASE WHEN bin - lag(bin) OVER w = 1 AND class = lag(class) OVER w THEN 0 ELSE 1 END AS brk
      FROM (SELECT *, {CLASS} AS class FROM heat) AS k WINDOW w AS (PARTITION BY route_id, direction_id, hour ORDER BY bin)) AS k) AS k
  GROUP BY route_id, direction_id, hour, island HAVING count(*) >= 3 AND avg(mph) < 6""", ("mph",))  # fmt: skip
def slow_stretches(spark, sf_dir):
    return grid.slow_stretches(t.heat(spark, sf_dir))


@query(f"SELECT route_id, direction_id, bin, hour, {CLASS}::INT AS speed_class FROM heat")
def speed_class(spark, sf_dir):
    return t.heat(spark, sf_dir).select("route_id", "direction_id", "bin", "hour", scalars.class_by_edges(F.col("mph"), scalars.SPEED_EDGES).alias("speed_class"))


@query("SELECT mode, hour, (s1 + s3) / (s0 + s1 + s2 + s3) AS stuck FROM fleet_hours WHERE s0 + s1 + s2 + s3 > 0", ("stuck",))
def stuck_share(spark, sf_dir):
    total = F.col("s0") + F.col("s1") + F.col("s2") + F.col("s3")
    return grid.fleet_budget(t.state_pings(spark, sf_dir)).where(total > 0).select("mode", "hour", ((F.col("s1") + F.col("s3")) / total).alias("stuck"))


@query("""SELECT day, trip, count(*) AS n, CAST(sum(t * state) AS BIGINT) AS checksum, min(t) AS first_t FROM state_ping GROUP BY day, trip""")
def trip_traces(spark, sf_dir):
    traces = grid.trip_traces(t.state_pings(spark, sf_dir))
    each = F.aggregate("trace", F.lit(0).cast("long"), lambda a, p: a + p["t"] * p["state"])
    return traces.select("day", "trip", F.size("trace").cast("long").alias("n"), each.alias("checksum"), F.col("trace")[0]["t"].alias("first_t"))


# Sketches of each day, kept in its partition, merged over the month: ranks are off by less than 1%.
@query("SELECT event_type, name, count(*) AS n, true AS near FROM events, (SELECT unnest(['median', 'p90']) AS name) AS q WHERE value IS NOT NULL GROUP BY 1, 2")
def daily_quantile_sketches(spark, sf_dir):
    from fleetspark.functions import quantiles
    from fleetspark.sources import files

    path = files.landing(spark)
    rows = fixtures.table(spark, sf_dir, "events").select("event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    files.write_by_day(quantiles.daily_sketches(rows, ["event_type"], "value"), path)
    kept = spark.read.schema("event_type string, n long, sketch binary, day string").parquet(path)
    shares = {"median": 0.5, "p90": 0.9}
    found = quantiles.merged_quantiles(kept, ["event_type"], shares)
    each = found.select("event_type", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(q).alias("share"), F.col(k).alias("value")) for k, q in shares.items()])).alias("q")).select("event_type", "n", "q.*")
    ranked = each.join(rows.select("event_type", F.col("value").alias("v")), "event_type").where("v is not null").groupBy("event_type", "name", "n", "share").agg(F.count_if(F.col("v") <= F.col("value")).alias("up_to"), F.count_if(F.col("v") < F.col("value")).alias("below"))
    off = F.greatest(F.col("below") / F.col("n") - F.col("share"), F.col("share") - F.col("up_to") / F.col("n"), F.lit(0.0))
    return ranked.select("event_type", "name", "n", (off < 0.01).alias("near"))
