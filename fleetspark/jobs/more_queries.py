"""Queries over delay cells, transfers, the live feed and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.jobs import tables as t
from fleetspark.jobs.registry import query
from fleetspark.operators import scenarios
from fleetspark.sources import files, fixtures
from fleetspark.streaming import live


# The events land in six polls, five days each, one row in ten a poll too late.
POLL = "CAST(floor((day(ts) - 1) / 6) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS INT)"
POLLED = f"(SELECT *, {POLL} AS poll FROM events)"
# The watermark while a poll is worked on: ten minutes behind the newest row of those before.
MARKS = f"(SELECT poll, coalesce(max(newest) OVER (ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000, 0) AS mark FROM (SELECT poll, max(epoch_ms(ts)) AS newest FROM {POLLED} AS e GROUP BY 1) AS k)"
# State drops what is not beyond the watermark of the poll before.
LATE = f"(SELECT e.*, epoch_us(ts) <= coalesce(m.mark, 0) * 1000 AS late FROM {POLLED} AS e LEFT JOIN {MARKS} AS m ON m.poll = e.poll - 1)"


#: Files of a poll at most.
MOST_FILES = 32


def events(spark, sf_dir, path):
    """The events as a stream of polls that land one after the other in ``path``.

    The stream takes a poll by its number of files, so each poll has as many as the
    table is read in parts, and empty ones stand in for parts without rows of it.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("poll", F.expr(POLL))
    parts = min(max(rows.rdd.getNumPartitions(), 1), MOST_FILES)
    for k in range(6):
        rows.where(F.col("poll") == k).coalesce(parts).write.mode("append").parquet(f"{path}/polls")
        landed = len(spark.read.schema(rows.schema).parquet(f"{path}/polls").inputFiles())
        for _ in range(parts * (k + 1) - landed):
            rows.limit(0).write.mode("append").parquet(f"{path}/polls")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(f"{path}/polls")


SENDER = "user_id * 8 + length(event_type)"


@query(f"""SELECT vehicle_id, position_at, seq FROM (
    SELECT *, lag(position_at) OVER w AS last, lag(poll) OVER w AS last_poll, max(epoch_ms(ts)) OVER (PARTITION BY vehicle_id ORDER BY poll, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM (SELECT {SENDER} AS vehicle_id, CAST(floor(value / 200) AS BIGINT) AS position_at, event_id, event_id AS seq, poll, ts FROM {POLLED} AS e) AS e WINDOW w AS (PARTITION BY vehicle_id ORDER BY poll, event_id)) AS k
  LEFT JOIN {MARKS} AS m ON m.poll = k.poll WHERE last IS NULL OR last <> position_at OR (last_poll < k.poll AND m.mark >= seen + 86400000)""")  # fmt: skip
def live_changed_only(spark, sf_dir):
    """Each user's events of one kind are a vehicle; one without any in a poll is forgotten after a day."""
    path = files.landing(spark)
    rows = events(spark, sf_dir, path).selectExpr(f"{SENDER} AS vehicle_id", "cast(floor(value / 200) AS bigint) AS at", "event_id AS seq", "cast(ts AS timestamp) AS polled")
    return live.finished(live.live_changed_only(rows, 86_400, "10 minutes"), path).withColumnRenamed("at", "position_at")


def hourly(spark, sf_dir, path):
    return events(spark, sf_dir, path).select(F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"SELECT DISTINCT user_id AS vehicle_id, epoch_us(ts) AS at_us FROM {LATE} AS e WHERE NOT late")
def live_dedupe(spark, sf_dir):
    path = files.landing(spark)
    return live.finished(live.live_dedupe(hourly(spark, sf_dir, path)), path).select("vehicle_id", F.unix_micros("ts").alias("at_us"))


@query(f"SELECT poll::BIGINT AS batch, count(*) AS n, (count(*) FILTER (WHERE late))::BIGINT AS dropped_late FROM {LATE} AS e GROUP BY 1")
def live_progress(spark, sf_dir):
    """What the listener hears of the stream of ``live_dedupe``."""
    path, heard = files.landing(spark), live.Progress()
    live.finished(live.live_dedupe(hourly(spark, sf_dir, path)), path, heard)
    return heard.table(spark).where("rows > 0").select("batch", F.col("rows").alias("n"), "dropped_late")


ENTITY = "CASE WHEN event_id % 7 = 0 THEN 'x' ELSE cast(user_id AS string) END AS id"


@query("""SELECT user_id AS vehicle_id, CAST(round_even((event_id % 4000) / 10.0::DOUBLE, 0) AS INT) % 360 AS heading, CAST(round_even(CAST(floor(value) AS DOUBLE) * 2.23694::DOUBLE, 0) AS INT) AS average_speed,
  coalesce(CASE WHEN event_id % 3 > 0 THEN 1 END, -1)::INT AS direction_id, count(*) AS n FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY ALL""")  # fmt: skip
def live_normalise(spark, sf_dir):
    path = files.landing(spark)
    rows = events(spark, sf_dir, path).selectExpr(
        ENTITY, "CASE WHEN event_id % 11 > 0 THEN -122.4D END AS lon", "37.7D AS lat", "(event_id % 4000) / 10D AS bearing", "cast(floor(value) AS double) AS speed", "unix_timestamp(cast(ts AS timestamp)) AS ts",
        "0L AS header_ts", "'N' AS route_id", "CASE WHEN event_id % 3 > 0 THEN 1 END AS direction_id", "'t' AS trip_id",
    )
    return live.finished(live.live_normalise(rows), path).groupBy("vehicle_id", "heading", "average_speed", "direction_id").agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS local_date, count(*) AS n, count(DISTINCT user_id) AS vehicles FROM events GROUP BY 1")
def live_to_day_files(spark, sf_dir):
    path = files.landing(spark)
    live.write_by_day(events(spark, sf_dir, path).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), f"{path}/days", f"{path}/state").awaitTermination()
    found = spark.read.schema("event_id long, user_id long, day string").parquet(f"{path}/days")
    return found.groupBy(F.col("day").alias("local_date")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("vehicles"))


@query(f"""SELECT poll AS batch, row_number() OVER w AS polls, (sum(n) OVER w)::BIGINT AS n, (sum(errors) OVER w)::BIGINT AS errors, max(last_s) OVER w AS last_s, n AS last_n, vehicles AS last_vehicles FROM (
    SELECT poll, count(*) AS n, count(*) FILTER (WHERE event_id % 7 = 0) AS errors, epoch_ms(max(ts)) // 1000 AS last_s, count(DISTINCT user_id) FILTER (WHERE event_id % 7 > 0) AS vehicles FROM {POLLED} AS e GROUP BY 1) AS k
  WINDOW w AS (ORDER BY poll)""")  # fmt: skip
def live_status(spark, sf_dir):
    path = files.landing(spark)
    rows = events(spark, sf_dir, path).selectExpr("CASE WHEN event_id % 7 > 0 THEN user_id END AS vehicle_id", "cast(ts AS timestamp) AS ts")
    live.live_status(rows, f"{path}/status", f"{path}/state").awaitTermination()
    found = live.status_so_far(spark.read.schema("rows long, vehicles long, errors long, last timestamp, batch int").parquet(f"{path}/status"))
    return found.select("batch", "polls", F.col("rows").alias("n"), "errors", F.unix_timestamp("last").alias("last_s"), F.col("last_rows").alias("last_n"), "last_vehicles")


@query("SELECT vehicle_id, route_id, direction_id, count(*) AS n, sum(average_speed)::BIGINT AS speeds, sum(heading::INT)::BIGINT AS headings FROM ping GROUP BY 1, 2, 3")
def ping_csv_read(spark, sf_dir):
    path = files.landing(spark)
    rows = t.view(spark, sf_dir, "ping").selectExpr("timestamp_ntz'2026-06-10 00:00:00' + make_dt_interval(0, 0, 0, t) AS vehicle_position_date_time", "vehicle_id", "x AS loc_x", "y AS loc_y", "cast(heading AS int) AS heading", "average_speed", "route_id", "direction_id", "gtfs_trip_id AS trip_id")
    rows.write.option("header", True).csv(path)
    return files.read_pings(spark, path).groupBy("vehicle_id", "route_id", "direction_id").agg(F.count("*").alias("n"), F.sum("average_speed").alias("speeds"), F.sum("heading").alias("headings"))


@query("SELECT g.trip_id::VARCHAR AS trip_id, g.route_id, length(g.route_id) % 6 AS kind, count(s.trip_id) AS stops FROM gtfs_trip AS g LEFT JOIN stop_time AS s ON s.trip_id = g.trip_id GROUP BY 1, 2, 3")
def gtfs_read(spark, sf_dir):
    path = files.landing(spark)
    trips, times = t.view(spark, sf_dir, "gtfs_trip"), t.view(spark, sf_dir, "stop_time")
    tables = {
        "routes": trips.selectExpr("route_id", "cast(length(route_id) % 6 AS string) AS route_type", "route_id AS route_short_name", "route_id AS route_long_name", "'' AS route_color").distinct(),
        "trips": trips.selectExpr("headsign AS trip_headsign", "trip_id", "route_id", "service_id", "shape_id", "direction_id"),
        "stops": t.view(spark, sf_dir, "stop").selectExpr("stop_id", "name AS stop_name", "d AS stop_lon", "d AS stop_lat"),
        "shapes": fixtures.shape_points(t.view(spark, sf_dir, "route_dir")).selectExpr("shape_id", "seq AS shape_pt_sequence", "x AS shape_pt_lon", "y AS shape_pt_lat"),
        "stop_times": times.selectExpr("trip_id", "stop_id", "stop_sequence", "departure AS arrival_time", "departure AS departure_time"),
    }
    for name, rows in tables.items():
        rows.write.option("header", True).csv(f"{path}/{name}.txt")
    read = files.read_gtfs(spark, path)
    counted = read["stop_times"].groupBy("trip_id").agg(F.count("*").alias("stops"))
    own = read["trips"].join(read["routes"].select("route_id", F.col("route_type").cast("int").alias("kind")), "route_id").join(counted, "trip_id", "left")
    return own.select("trip_id", "route_id", "kind", F.coalesce("stops", F.lit(0)).alias("stops"))


@query("SELECT signal_id::VARCHAR AS cnn, x AS lon, y AS lat FROM signal WHERE signal_id % 4 <> 0 AND signal_id % 5 <> 0", ("lon", "lat"))
def signal_read(spark, sf_dir):
    """The signals' file is one JSON array."""
    place = F.when(F.col("signal_id") % 5 != 0, F.struct(F.array("x", "y").alias("coordinates"))).alias("shape")
    kind = F.when(F.col("signal_id") % 4 == 0, "other").otherwise("SIGNAL").alias("type")
    one = F.struct(F.col("signal_id").cast("string").alias("cnn"), kind, F.col("name").alias("street1"), F.col("name").alias("street2"), place)
    path = files.landing(spark)
    t.view(spark, sf_dir, "signal").agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)
    return files.read_signals(spark, path, ("SIGNAL",)).select("cnn", "lon", "lat")


@query("SELECT strftime(ts, '%Y-%m-%d') AS local_date, count(*) AS n, sum(event_id)::BIGINT AS ids FROM raw_ping WHERE day(ts) <= 20 GROUP BY 1")
def parquet_by_day(spark, sf_dir):
    """All days are written, then the first twenty again, then days are read by name."""
    path = files.landing(spark)
    rows = t.view(spark, sf_dir, "raw_ping").select("event_id", "vehicle_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    files.write_by_day(rows, path)
    files.write_by_day(rows.where("day <= '2024-01-20'"), path)
    found = spark.read.schema("event_id long, vehicle_id long, day string").parquet(path).where("substr(day, 9, 2) <= '20'")
    return found.groupBy(F.col("day").alias("local_date")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, vehicle_id, t FROM ping")
def json_docs(spark, sf_dir):
    """One document per vehicle, its pings in time order, read back into rows."""
    path = files.landing(spark)
    files.write_documents(t.view(spark, sf_dir, "ping").select("vehicle_id", "event_id", "t"), path, "vehicle_id", "t")
    read = spark.read.schema("value string, vehicle_id long").text(path)
    each = read.select("vehicle_id", F.explode(F.from_json("value", "array<struct<row: struct<event_id: long, t: int>>>")).alias("r"))
    return each.select(F.col("r.row.event_id").alias("event_id"), "vehicle_id", F.col("r.row.t").alias("t"))


CELLS = """(SELECT route_id, direction_id, mode, bin, sum(delay) AS delay, bin * 100.0::DOUBLE + 50 AS x, 500 * CAST(substr(route_id, 2) AS INT) + 250.0::DOUBLE * direction_id AS y
  FROM delay WHERE delay IS NOT NULL AND bin * 100 + 50 BETWEEN 300 AND 4700 GROUP BY ALL)"""


@query(f"""SELECT cx, cy, hours, lon_x, lat_y, routes, bus_hours FROM (SELECT CAST(floor(x / 150) AS BIGINT) AS cx, CAST(floor(y / 150) AS BIGINT) AS cy, sum(delay) / 3600.0::DOUBLE AS hours,
    sum(x * (delay + 0.000001::DOUBLE)) / sum(delay + 0.000001::DOUBLE) AS lon_x, sum(y * (delay + 0.000001::DOUBLE)) / sum(delay + 0.000001::DOUBLE) AS lat_y, count(DISTINCT route_id) AS routes,
    sum(CASE WHEN mode = 'bus' THEN delay ELSE 0.0::DOUBLE END) / 3600.0::DOUBLE AS bus_hours FROM {CELLS} AS c GROUP BY 1, 2) AS k WHERE hours >= 0.01::DOUBLE ORDER BY round(hours, 6) DESC, cx, cy LIMIT 600""", ("hours", "lon_x", "lat_y", "bus_hours"))  # fmt: skip
def hotspots(spark, sf_dir):
    points = fixtures.shape_points(t.view(spark, sf_dir, "route_dir"))
    return scenarios.hotspots(t.delays(spark, sf_dir), points, least_hours=0.01)


# The grid has the hours 5 to 23; 4 and 24 look into it, 3 and 25 find nothing.
@query("""SELECT s.signal_id, h.hour, sum((g1 - g0) / (CASE WHEN g.mph > 0 THEN g.mph ELSE 7.0::DOUBLE END / 2.23694::DOUBLE)) / 60.0::DOUBLE AS minutes FROM (
    SELECT *, greatest(bin * 100.0::DOUBLE, d0) AS g0, least(bin * 100.0::DOUBLE + 100, d1) AS g1 FROM (
      SELECT signal_id, concat('R', signal_id % 4) AS route_id, CAST(signal_id % 2 AS INT) AS direction_id, x / 2 AS d0, x / 2 + 400 AS d1, unnest(range(CAST(floor(x / 200) AS INT), CAST(floor((x / 2 + 400 - 0.000001::DOUBLE) / 100) AS INT) + 1))::INT AS bin FROM signal) AS s) AS s
  CROSS JOIN (SELECT unnest(range(3, 26))::INT AS hour) AS h LEFT JOIN heat AS g ON g.route_id = s.route_id AND g.direction_id = s.direction_id AND g.bin = s.bin AND g.hour = CASE WHEN h.hour = 4 THEN 5 WHEN h.hour = 24 THEN 23 ELSE h.hour END GROUP BY 1, 2""", ("minutes",))  # fmt: skip
def segment_minutes(spark, sf_dir):
    parts = t.view(spark, sf_dir, "signal").selectExpr("signal_id", "concat('R', signal_id % 4) AS route_id", "cast(signal_id % 2 AS int) AS direction_id", "x / 2 AS d0", "x / 2 + 400 AS d1")
    return scenarios.segment_minutes(parts, t.heat(spark, sf_dir), "signal_id", range(3, 26))


@query("""SELECT s.signal_id, array_to_string(list_sort(list(DISTINCT o.fam)), ',') AS families FROM (SELECT signal_id, x, y, signal_id % 5 AS fam FROM signal) AS s
  JOIN (SELECT x, y, signal_id % 5 AS fam FROM signal) AS o ON o.fam <> s.fam AND sqrt((s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y)) < 120 GROUP BY 1""")  # fmt: skip
def stop_transfers(spark, sf_dir):
    stops = t.view(spark, sf_dir, "signal").select("signal_id", (F.col("signal_id") % 5).cast("string").alias("family"), "x", "y")
    return scenarios.nearby_families(stops, "signal_id").select("signal_id", F.concat_ws(",", "families").alias("families"))


REMOVED = "d % 180 = 0"


@query(f"""SELECT route_id, direction_id, stop_id, removed, CASE WHEN removed THEN least(coalesce(d - before, 1e9::DOUBLE), coalesce(after - d, 1e9::DOUBLE)) END AS walk,
    CASE WHEN removed THEN coalesce(p, 0.0::DOUBLE) * 12 ELSE 0.0::DOUBLE END AS saved FROM (
  SELECT s.*, {REMOVED} AS removed, max(CASE WHEN NOT {REMOVED} THEN d END) OVER (PARTITION BY route_id, direction_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    min(CASE WHEN NOT {REMOVED} THEN d END) OVER (PARTITION BY route_id, direction_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM dwell AS s) AS k""", ("walk", "saved"))  # fmt: skip
def stop_removal_impact(spark, sf_dir):
    from fleetspark.operators import grid

    dwell = grid.stop_dwell(t.state_pings(spark, sf_dir), t.extents(spark, sf_dir), t.view(spark, sf_dir, "stop"))
    return scenarios.stop_removal_impact(dwell.withColumn("removed", F.expr(REMOVED)))
