"""Queries over raw pings: cleaning and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fleetspark.functions import geo, scalars
from fleetspark.jobs import tables as t
from fleetspark.jobs.registry import query
from fleetspark.operators import cleaning
from fleetspark.sources import files, fixtures


# The dump: one file for each four days; every seventeenth line is cut off in the middle, and one in nineteen has a speed that is no number.
@query("""SELECT event_id::VARCHAR AS vehicle_id, CAST(json_extract_string(props, '$.k') AS INT) AS direction_id, value AS speed, -1 AS part, 1::BIGINT AS n FROM events WHERE event_type = 'error' AND event_id % 17 <> 0 AND event_id % 19 <> 0
  UNION ALL SELECT 'broken', -1, 0.0::DOUBLE, CAST(floor((day(ts) - 1) / 4) AS INT), count(*) FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0 GROUP BY 4""", ("speed",))  # fmt: skip
def feed_extract(spark, sf_dir):
    """Rows of one feed of a gzipped dump, and how many lines of each file went to quarantine."""
    path, part = files.landing(spark), F.floor((F.dayofmonth("ts") - 1) / 4).cast("int")
    fields = F.struct(F.col("event_type").alias("gtfs_dataset_name"), F.col("event_id").cast("string").alias("vehicle_id"), F.get_json_object("props", "$.k").cast("int").alias("trip_direction_id"), F.col("value").alias("position_speed"))
    line = F.to_json(fields)
    broken = F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 40)).when(F.col("event_id") % 19 == 0, F.regexp_replace(line, '"position_speed":[^}]*', '"position_speed":"fast"')).otherwise(line)
    fixtures.table(spark, sf_dir, "events").select(broken.alias("value"), part.alias("part")).write.option("compression", "gzip").partitionBy("part").text(f"{path}/dump")
    files.land_feed(spark, f"{path}/dump", "error", f"{path}/rows", f"{path}/broken")
    rows = spark.read.schema("vehicle_id string, trip_direction_id int, position_speed double").parquet(f"{path}/rows")
    rows = rows.select("vehicle_id", F.col("trip_direction_id").alias("direction_id"), F.col("position_speed").alias("speed"), F.lit(-1).alias("part"), F.lit(1).cast("long").alias("n"))
    lost = spark.read.schema("file string, line string").parquet(f"{path}/broken").groupBy(F.regexp_extract("file", "part=([0-9]+)/", 1).cast("int").alias("part")).agg(F.count("*").alias("n"))
    return rows.unionByName(lost.select(F.lit("broken").alias("vehicle_id"), F.lit(-1).alias("direction_id"), F.lit(0.0).alias("speed"), "part", "n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS local_date, count(*) AS n_rows, count(DISTINCT vehicle_id) AS vehicles FROM raw_ping GROUP BY 1")
def feed_profile(spark, sf_dir):
    return cleaning.feed_profile(t.view(spark, sf_dir, "raw_ping"))


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events) AS k WHERE value IS NOT NULL", ("value",))
def drop_incomplete(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value"))
    return cleaning.drop_incomplete(rows, ("value",))


@query("SELECT event_id, vehicle_id, t FROM ping WHERE x BETWEEN 500 AND 9000 AND y BETWEEN 0 AND 1500 AND t >= 10800 AND t < 86399")
def bbox_time_filter(spark, sf_dir):
    return cleaning.bbox_time_filter(t.view(spark, sf_dir, "ping"), 500.0, 0.0, 9000.0, 1500.0).select("event_id", "vehicle_id", "t")


@query("SELECT event_id, vehicle_id, t FROM kept_ping")
def dedupe_pings(spark, sf_dir):
    return cleaning.dedupe_pings(t.view(spark, sf_dir, "raw_ping")).select("event_id", "vehicle_id", "t")


@query("SELECT event_id, CAST(round_even(value / 10.0::DOUBLE * 2.23694::DOUBLE, 0) AS INT) AS mph, CAST(round_even(value, 0) AS INT) % 360 AS heading FROM events")
def unit_normalise(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "events")
    return events.select("event_id", scalars.mph(F.col("value") / F.lit(10.0)).alias("mph"), scalars.heading_degrees(F.col("value"), True).alias("heading"))


@query("SELECT event_id, user_id AS vehicle_id FROM events WHERE user_id % 7 <> 0")
def numeric_id_filter(spark, sf_dir):
    text = F.expr("CASE WHEN user_id % 7 = 0 THEN concat('x', user_id) ELSE cast(user_id AS string) END AS vehicle_id")
    return cleaning.numeric_ids(fixtures.table(spark, sf_dir, "events").select("event_id", text))


@query("SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS seconds FROM events")
def seconds_of_day(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "events").select("event_id", scalars.seconds_of_day(F.col("ts")).alias("seconds"))


@query("SELECT trip_id, stop_sequence, CAST(substr(departure, 1, 2) AS INT) * 3600 + CAST(substr(departure, 4, 2) AS INT) * 60 + CAST(substr(departure, 7, 2) AS INT) AS seconds FROM stop_time")
def hms_seconds(spark, sf_dir):
    return t.view(spark, sf_dir, "stop_time").select("trip_id", "stop_sequence", scalars.hms_seconds(F.col("departure")).alias("seconds"))


# January: the zone is eight hours behind all month.
@query("SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def utc_to_local(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    local = scalars.utc_to_local(text, "America/Los_Angeles")
    return fixtures.table(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"))


@query("SELECT event_id, concat('2024-03-05 ', strftime(ts, '%H:%M:%S')) AS folded FROM events")
def composite_day(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "events").select("event_id", F.date_format(scalars.composite_time(F.col("ts"), "2024-03-05"), "yyyy-MM-dd HH:mm:ss").alias("folded"))


EAST = geo.METRES_LON * math.cos(math.radians(geo.ORIGIN[1]))


@query(f"SELECT event_id, x / {EAST!r}::DOUBLE + {geo.ORIGIN[0]!r}::DOUBLE AS lon, y / 110540.0::DOUBLE + {geo.ORIGIN[1]!r}::DOUBLE AS lat, x AS back_x, y AS back_y FROM ping", ("lon", "lat", "back_x", "back_y"))
def project_xy(spark, sf_dir):
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"))
    rows = t.view(spark, sf_dir, "ping").select("event_id", lon.alias("lon"), lat.alias("lat"))
    x, y = geo.to_xy(F.col("lon"), F.col("lat"))
    return rows.select("*", x.alias("back_x"), y.alias("back_y"))


@query("""SELECT event_id, (degrees(atan2(x - 2500, y - 900)) + 360) - floor((degrees(atan2(x - 2500, y - 900)) + 360) / 360) * 360 AS bearing,
  least(abs(heading - 300), 360 - abs(heading - 300)) AS turned FROM ping""", ("bearing", "turned"))  # fmt: skip
def bearing_angle(spark, sf_dir):
    b = geo.bearing(F.col("x") - F.lit(2500.0), F.col("y") - F.lit(900.0))
    return t.view(spark, sf_dir, "ping").select("event_id", b.alias("bearing"), geo.angle_between(F.col("heading"), F.lit(300.0)).alias("turned"))


@query("""SELECT o_orderkey AS id, CAST(o_custkey % 50 AS STRING) AS family, CASE o_custkey % 6 WHEN 0 THEN 'rail' WHEN 3 THEN 'bus' WHEN 5 THEN 'cable' ELSE 'other' END AS mode FROM orders""")
def route_family_mode(spark, sf_dir):
    route = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN concat(o_custkey % 50, 'R') ELSE cast(o_custkey % 50 AS string) END")
    return fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scalars.route_family(route).alias("family"), scalars.mode_of_type((F.col("o_custkey") % 6).cast("string")).alias("mode"))


@query("""SELECT DISTINCT vehicle_id, CASE WHEN vehicle_id BETWEEN 0 AND 4 THEN 'motor' WHEN vehicle_id BETWEEN 5 AND 9 THEN 'trolley' WHEN vehicle_id BETWEEN 10 AND 49 THEN 'articulated'
  WHEN vehicle_id BETWEEN 50 AND 99 THEN 'rail' ELSE 'other' END AS vclass FROM ping""")  # fmt: skip
def vehicle_class_range(spark, sf_dir):
    return t.view(spark, sf_dir, "ping").select("vehicle_id").distinct().withColumn("vclass", scalars.vehicle_class(F.col("vehicle_id")))


@query("""SELECT vehicle_id, coalesce(mode, 'other') AS vclass FROM (SELECT DISTINCT vehicle_id FROM raw_ping) AS v LEFT JOIN (
  SELECT vehicle_id, mode, row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC, mode) AS k FROM (
    SELECT vehicle_id, CASE WHEN user_id % 5 = 1 THEN 'rail' WHEN user_id % 5 < 4 THEN 'bus' ELSE 'other' END AS mode, count(*) AS n FROM raw_ping WHERE user_id % 5 <> 0 GROUP BY 1, 2) AS c) AS m USING (vehicle_id) WHERE k = 1 OR k IS NULL""")  # fmt: skip
def vehicle_class_mode(spark, sf_dir):
    pings = t.view(spark, sf_dir, "raw_ping").select("vehicle_id", F.expr("CASE WHEN user_id % 5 = 0 THEN ' ' ELSE concat('Q', user_id % 5) END AS route_id"))
    modes = spark.createDataFrame([("Q1", "rail"), ("Q2", "bus"), ("Q3", "bus")], "route_id string, mode string")
    return cleaning.vehicle_class_mode(pings, modes)


@query("SELECT s_suppkey AS id, concat(CAST(s_suppkey % 30 AS STRING), 'th St & Supplier') AS name FROM supplier")
def titlecase_names(spark, sf_dir):
    raw = F.concat(F.lpad((F.col("s_suppkey") % 30).cast("string"), 2, "0"), F.lit("TH ST & SUPPLIER"))
    return fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), scalars.titlecase(raw).alias("name"))
