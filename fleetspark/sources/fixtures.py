"""The fleet's tables, derived from the general tables of a data folder.

A month of events becomes one day of pings: ten users are a vehicle, thirty
days are pressed into 86,400 seconds. The statements run on Spark and, with the
same text, on the engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view's SQL, over the given tables and the views before it.
VIEWS = {
    "raw_ping": """
      SELECT event_id, CAST(floor(user_id / 10) AS BIGINT) AS vehicle_id, user_id, ts, event_type,
        CAST(floor(((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 30) AS INT) AS t,
        CAST(floor(value) AS INT) AS step, value, props
      FROM events""",
    "kept_ping": """
      SELECT event_id, vehicle_id, ts, event_type, t, step, value, CAST(floor(t / 7200) AS INT) AS run_no,
        CAST(floor(vehicle_id / 2) AS INT) % 4 AS route_no,
        CASE WHEN event_type = 'error' THEN 0 ELSE step % 25 END AS average_speed
      FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, t ORDER BY event_id) AS rn FROM raw_ping) AS k WHERE rn = 1""",
    "ping": """
      SELECT 1 AS day, event_id, vehicle_id, t, average_speed, run_no,
        CAST(route_no AS INT) AS route_no, CAST(concat('R', route_no) AS STRING) AS route_id, CAST(run_no % 2 AS INT) AS direction_id,
        vehicle_id * 100 + run_no AS trip, concat('G', CAST(floor(vehicle_id / 2) AS BIGINT) * 100 + run_no) AS gtfs_trip_id,
        CASE WHEN route_no = 3 THEN 'rail' ELSE 'bus' END AS mode,
        CAST(sum(step) OVER w AS DOUBLE) AS along, CAST(sum(step) OVER w AS DOUBLE) AS x,
        CAST(500 * route_no + 250 * (run_no % 2) + (event_id % 7) * 10 - 30 AS DOUBLE) AS y,
        CAST(90 + (event_id % 121) - 60 AS DOUBLE) AS heading
      FROM kept_ping WINDOW w AS (PARTITION BY vehicle_id, run_no ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "route_dir": """
      SELECT concat('R', r.n) AS route_id, d.n AS direction_id, CASE WHEN r.n = 3 THEN 'rail' ELSE 'bus' END AS mode,
        CAST(5000 AS DOUBLE) AS length, concat('S', r.n * 2 + d.n) AS shape_id, r.n AS route_no
      FROM (SELECT DISTINCT CAST(p_partkey % 4 AS INT) AS n FROM part) AS r, (SELECT DISTINCT CAST(p_partkey % 2 AS INT) AS n FROM part) AS d""",
    "stop": """
      SELECT concat('R', p_partkey % 4) AS route_id, CAST(floor(p_partkey / 4) AS INT) % 2 AS direction_id, CAST(p_size * 90 AS DOUBLE) AS d,
        min(p_partkey) AS stop_id, min(p_name) AS name
      FROM part GROUP BY 1, 2, 3""",
    "stop_name": """
      SELECT DISTINCT concat('R', p_partkey % 4) AS route_id, CAST(floor(p_partkey / 4) AS INT) % 2 AS direction_id, CAST(p_size * 90 AS DOUBLE) AS d, p_name AS name
      FROM part""",
    "signal": """
      SELECT s_suppkey AS signal_id, s_name AS name, CAST(floor((s_acctbal + 1000) / CAST(2.2 AS DOUBLE)) AS DOUBLE) AS x,
        CAST(500 * (s_nationkey % 4) + 250 * (s_suppkey % 2) + (s_suppkey % 31) - 15 AS DOUBLE) AS y
      FROM supplier""",
    "gtfs_trip": """
      SELECT o_orderkey AS trip_id, o_orderpriority AS route_id, CAST(o_custkey % 2 AS INT) AS direction_id, o_orderstatus AS service_id,
        CAST(o_custkey % 5 AS INT) AS shape_id, concat('to ', o_custkey % 3) AS headsign
      FROM orders""",
    "stop_time": """
      SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence, CAST(l_suppkey % 20 AS INT) AS stop_id,
        concat(lpad(CAST(4 + l_orderkey % 21 AS STRING), 2, '0'), ':', lpad(CAST(l_linenumber * 5 AS STRING), 2, '0'), ':00') AS departure
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) AS k WHERE rn = 1""",
}
_USES = {"kept_ping": ("raw_ping",), "ping": ("kept_ping",)}
TABLES = ("events", "part", "supplier", "orders", "lineitem", "customer", "nation", "region")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables in ``sf_dir``."""
    text = VIEWS[name]
    used = {n: table(spark, sf_dir, n) for n in TABLES if f"FROM {n}" in text}
    used |= {n: view(spark, sf_dir, n) for n in _USES.get(name, ())}
    for n in used:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **used)


def sql_views(names) -> list[tuple[str, str]]:
    """Names and statements of views, each after those that it uses."""
    out: list[tuple[str, str]] = []
    for name in names:
        for used in (*_USES.get(name, ()), name):
            for item in (*sql_views(_USES.get(used, ())), (used, VIEWS[used])) if used != name else ((name, VIEWS[name]),):
                if item not in out:
                    out.append(item)
    return out


def shape_points(route_dir: DataFrame) -> DataFrame:
    """Points every 10 m of the straight shapes: route_id, direction_id, mode, seq, x, y, d, bearing."""
    return route_dir.selectExpr("route_id", "direction_id", "mode", "shape_id", "route_no", "explode(sequence(0, 499)) AS seq").selectExpr(
        "route_id", "direction_id", "mode", "shape_id", "seq", "cast(seq * 10 AS double) AS x", "cast(500 * route_no + 250 * direction_id AS double) AS y", "cast(seq * 10 AS double) AS d", "90D AS bearing"
    )
