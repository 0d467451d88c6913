"""Corridors, tunnels and portals: which routes share a line, and the times between its stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import geo
from fleetspark.functions.quantiles import quantile
from fleetspark.functions.scalars import hms_seconds
from fleetspark.operators.matching import near_points
from fleetspark.operators.states import TRIP, position_interp

KEY = ("route_id", "direction_id")


def _hour(t: Column) -> Column:
    return F.floor(t / 3600).cast("int")


def _spread(seconds: str, sketch: int = 0) -> list[Column]:
    """Median and 90th percentile in minutes, and how many; see ``quantiles.quantile`` for ``sketch``."""
    return [(quantile(seconds, 0.5, sketch) / 60.0).alias("median"), (quantile(seconds, 0.9, sketch) / 60.0).alias("p90"), F.count(seconds).alias("n")]


def tunnel_ranges(stops: DataFrame, points: DataFrame, portals: DataFrame, routes: DataFrame, names: tuple[str, ...], radius: float = 60.0) -> DataFrame:
    """``route_id, direction_id, d0, d1``: the stretch underground of rail routes with a station named so.

    From the first to the last underground station or portal (x, y, portal_id)
    nearer than ``radius`` to the shape; to the route's end where that station is
    underground. A station is a place, and may have a row for each of its names.
    """
    under = F.lit(False)
    for name in names:
        under = under | F.col("name").startswith(name)
    own = stops.groupBy(*KEY, "d").agg(F.coalesce(F.bool_or(under), F.lit(False)).alias("_u")).groupBy(*KEY).agg(
        F.min(F.when(F.col("_u"), F.col("d"))).alias("_lo"), F.max(F.when(F.col("_u"), F.col("d"))).alias("_hi"), F.min_by("_u", "d").alias("_first"), F.max_by("_u", "d").alias("_last")
    )
    shape = points.select(*KEY, "d", F.col("x").alias("px"), F.col("y").alias("py"))
    close = near_points(portals.select("portal_id", "x", "y"), shape, radius).groupBy(*KEY, "portal_id").agg(F.min(F.struct("off", "d")).alias("_b"))
    mouths = close.groupBy(*KEY).agg(F.min("_b.d").alias("_plo"), F.max("_b.d").alias("_phi"))
    rows = own.where("_lo is not null").join(mouths, list(KEY), "left").join(routes.where("mode = 'rail'").select(*KEY, "length"), list(KEY))
    d0 = F.when(F.col("_first"), F.lit(0.0)).otherwise(F.least("_lo", "_plo"))
    d1 = F.when(F.col("_last"), F.col("length")).otherwise(F.greatest("_hi", "_phi"))
    return rows.select(*KEY, d0.alias("d0"), d1.alias("d1"))


def portal_passages(pings: DataFrame, entries: DataFrame, stations: DataFrame, approach: float = 400.0, before: float = 50.0) -> DataFrame:
    """One row per trip that passes its portal and station behind it: ``hour, approach, station, d, ride``.

    ``entries``: route_id, direction_id, entry. ``stations``: route_id,
    direction_id, station, d. Seconds count from ``approach`` metres before the
    portal; a trip without a station behind it has one row, its station null.
    """
    ends = entries.withColumn("_begin", F.greatest(F.col("entry") - approach, F.lit(0.0)))
    served = stations.join(ends, list(KEY)).where(F.col("d") >= F.col("entry") - before).select(*KEY, "station", "d")
    targets = ends.select(*KEY, F.col("_begin").alias("target")).union(ends.select(*KEY, "entry")).union(served.select(*KEY, "d")).distinct()
    passed = position_interp(pings, targets)
    at = lambda t, c: passed.select(*KEY, *TRIP, F.col("target").alias(t), F.col("t_at").alias(c))
    whole = ends.join(at("_begin", "_t0"), [*KEY, "_begin"]).join(at("entry", "_t1"), [*KEY, *TRIP, "entry"])
    whole = whole.select(*KEY, *TRIP, "_t0", _hour(F.col("_t0")).alias("hour"), (F.col("_t1") - F.col("_t0")).alias("approach"))
    rides = served.join(at("d", "_t"), [*KEY, "d"]).select(*KEY, *TRIP, "station", "d", "_t")
    return whole.join(rides, [*KEY, *TRIP], "left").withColumn("ride", F.col("_t") - F.col("_t0")).drop("_t0", "_t")


def portal_delay(passages: DataFrame, least: int = 2, sketch: int = 0) -> DataFrame:
    """Minutes before the portal by route, direction and hour: median, 90th percentile, trips, free flow (10th percentile of all)."""
    trips = passages.groupBy(*KEY, *TRIP).agg(F.first("hour").alias("hour"), F.first("approach").alias("approach"))
    free = trips.groupBy(*KEY).agg((quantile("approach", 0.1, sketch) / 60.0).alias("free_flow"))
    return trips.groupBy(*KEY, "hour").agg(*_spread("approach", sketch)).where(F.col("n") >= least).join(free, list(KEY))


def station_times(passages: DataFrame, least: int = 2) -> DataFrame:
    """Minutes from before the portal to each station, by hour."""
    return passages.where("ride is not null").groupBy(*KEY, "station", "hour").agg(*_spread("ride")).where(F.col("n") >= least)


def pooled_pairs(passages: DataFrame, least: int = 3) -> DataFrame:
    """Minutes from station to station in travel order, all routes together, by the hour before the portal."""
    first = passages.where("ride is not null").select(*KEY, *TRIP, "hour", "station", "d", "ride")
    second = first.select(*KEY, *TRIP, F.col("station").alias("to"), F.col("d").alias("_d"), F.col("ride").alias("_ride"))
    pairs = first.join(second, [*KEY, *TRIP]).where("d < _d").withColumn("seconds", F.col("_ride") - F.col("ride"))
    return pairs.groupBy(F.concat_ws("|", "station", "to").alias("pair"), "hour").agg(*_spread("seconds")).where(F.col("n") >= least)


def corridor_pair_times(pings: DataFrame, stations: DataFrame, least: int = 3, pooled: bool = False, days: int = 1, sketch: int = 0) -> DataFrame:
    """Observed minutes between stations by hour, of trips that span both; ``pooled`` over routes, with trips a day.

    ``stations``: route_id, direction_id, station, d. A pair is in the order of travel.
    """
    passed = position_interp(pings, stations.select(*KEY, F.col("d").alias("target")).distinct())
    at = stations.withColumnRenamed("d", "target").join(passed, [*KEY, "target"])
    second = at.select(*KEY, *TRIP, F.col("station").alias("to"), F.col("target").alias("_d"), F.col("t_at").alias("_t"))
    pairs = at.join(second, [*KEY, *TRIP]).where((F.col("target") < F.col("_d")) & (F.col("station") != F.col("to")))
    pairs = pairs.select("route_id", "direction_id", F.concat_ws("|", "station", "to").alias("pair"), _hour(F.col("t_at")).alias("hour"), (F.col("_t") - F.col("t_at")).alias("seconds"))
    by = ("direction_id", "pair", "hour") if pooled else (*KEY, "pair", "hour")
    out = pairs.groupBy(*by).agg(*_spread("seconds", sketch)).where(F.col("n") >= least)
    return out.withColumn("per_day", F.col("n") / F.lit(float(days))) if pooled else out


def schedule_pairs(stop_times: DataFrame, stations: DataFrame) -> DataFrame:
    """Scheduled trips and median minutes between stations by way and hour.

    ``stations``: stop_id, station, place (its order on the line). A trip runs
    "in" if it ends at a later place than it begins.
    """
    rows = stop_times.join(stations, "stop_id").withColumn("t", hms_seconds(F.col("departure")))
    w = Window.partitionBy("trip_id").orderBy("t", "stop_sequence")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_k": F.row_number().over(w), "_way": F.when(F.last("place").over(whole) > F.first("place").over(whole), "in").otherwise("out")})
    second = rows.select("trip_id", F.col("_k").alias("_k2"), F.col("station").alias("to"), F.col("t").alias("_t"))
    pairs = rows.join(second, "trip_id").where((F.col("_k") < F.col("_k2")) & (F.col("station") != F.col("to")))
    pairs = pairs.select(F.col("_way").alias("way"), F.concat_ws("|", "station", "to").alias("pair"), _hour(F.col("t")).alias("hour"), (F.col("_t") - F.col("t")).alias("seconds"))
    return pairs.groupBy("way", "pair", "hour").agg(F.count("*").alias("trips"), (F.percentile("seconds", 0.5) / 60.0).alias("median"))


def corridor_routes(points: DataFrame, lines: DataFrame, stations: DataFrame, radius: float = 40.0, turn: float = 30.0, least: float = 800.0, step: float = 10.0, hole: int = 10, reach: float = 250.0) -> DataFrame:
    """Routes that run along a line: ``line, d_on, d_off, m_on, m_off, inbound, stations`` of the longest run of each.

    ``points``: a shape's points every ``step`` metres, with seq and bearing.
    ``lines``: line, x, y, bearing, m (metres along). ``stations``: line,
    station, m. A point is on a line if the nearest of the line's points is
    within ``radius`` and heads the same or the opposite way; a run may have
    holes of ``hole`` points.
    """
    own = [*KEY, "line"]
    right = lines.select("line", F.col("x").alias("px"), F.col("y").alias("py"), F.col("m"), F.col("bearing").alias("_b"))
    near = near_points(points.select(*KEY, "seq", "d", "bearing", "x", "y"), right, radius)
    best = near.groupBy(*own, "seq", "d", "bearing").agg(F.min(F.struct("off", "m", "_b")).alias("_n")).select(*own, "seq", "d", "bearing", F.col("_n.m").alias("m"), F.col("_n._b").alias("_b"))
    apart = geo.angle_between(F.col("bearing"), F.col("_b"))
    on = best.where((apart < turn) | (apart > 180.0 - turn))
    w = Window.partitionBy(*own).orderBy("seq")
    on = on.withColumn("_n", F.count("*").over(Window.partitionBy(*own))).where(F.col("_n") * step >= least)
    on = on.withColumn("_new", F.when(F.col("seq") - F.lag("seq").over(w) > hole, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    runs = on.groupBy(*own, "_run").agg(F.count("*").alias("_n"), F.min_by("d", "seq").alias("d_on"), F.max_by("d", "seq").alias("d_off"), F.min_by("m", "seq").alias("m_on"), F.max_by("m", "seq").alias("m_off"))
    longest = Window.partitionBy(*own).orderBy(F.desc("_n"), "_run")
    runs = runs.withColumn("_k", F.row_number().over(longest)).where("_k = 1").select(*own, "d_on", "d_off", "m_on", "m_off", (F.col("m_off") > F.col("m_on")).alias("inbound"))
    # Of a line's stations, some ten, those near the run.
    at = stations.select("line", "station", F.col("m").alias("_m"))
    served = runs.join(at, "line").where((F.col("_m") >= F.least("m_on", "m_off") - reach) & (F.col("_m") <= F.greatest("m_on", "m_off") + reach))
    named = served.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("_m", "station"))), lambda s: s["station"]).alias("stations"))
    return runs.join(named, own).where(F.size("stations") >= 2)


def rapid_vs_local(parts: DataFrame, points: DataFrame, stops: DataFrame, pairs: DataFrame, radius: float = 25.0, least: int = 200, hours: tuple[int, int] = (7, 19), width: float = 100.0) -> DataFrame:
    """Seconds that a rapid route saves for each stop it leaves out, where both share a street.

    ``pairs``: rapid, local (route ids), direction_id. ``parts``: pings' time in
    bins of ``width`` metres. Only pairs with ``least`` shared points and fewer
    rapid than local stops on the stretch.
    """
    shape = lambda role: points.join(pairs.select("rapid", "local", "direction_id", F.col(role).alias("route_id")), list(KEY))
    right = shape("local").select("rapid", "direction_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("d").alias("_ld"))
    near = near_points(shape("rapid").select("rapid", "local", "direction_id", "seq", "d", "x", "y"), right, radius, ("rapid", "direction_id"))
    near = near.groupBy("rapid", "local", "direction_id", "seq", "d").agg(F.min(F.struct("off", "_ld")).alias("_n"))
    both = near.select("rapid", "local", "direction_id", F.explode(F.array(F.struct(F.lit("rapid").alias("role"), F.col("d")), F.struct(F.lit("local").alias("role"), F.col("_n._ld").alias("d")))).alias("_p"))
    both = both.select("rapid", "local", "direction_id", "_p.role", "_p.d").withColumn("route_id", F.when(F.col("role") == "rapid", F.col("rapid")).otherwise(F.col("local")))
    key = ["rapid", "local", "direction_id", "role", "route_id"]
    stretch = both.groupBy(*key).agg(F.count("*").alias("_n"), F.min("d").alias("_a"), F.max("d").alias("_b")).where(F.col("_n") >= least)
    bins = both.select(*key, F.floor(F.col("d") / width).cast("int").alias("bin")).distinct()
    own = parts.where(F.col("hour").between(*hours)).join(bins, [*KEY, "bin"])
    mean = own.groupBy(*key, "bin", *TRIP).agg(F.sum("time").alias("_s")).groupBy(*key, "bin").agg(F.avg("_s").alias("_s"))
    times = mean.groupBy(*key).agg(F.sum("_s").alias("_s"))
    counted = stops.join(stretch, list(KEY)).where(F.col("d").between(F.col("_a"), F.col("_b"))).groupBy(*key).agg(F.count("*").alias("_k"))
    rows = stretch.join(times, key, "left").join(counted, key, "left").na.fill({"_s": 0.0, "_k": 0})
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    out = rows.groupBy("rapid", "local", "direction_id").agg(of("local", "_s").alias("local_s"), of("rapid", "_s").alias("rapid_s"), of("local", "_k").alias("local_stops"), of("rapid", "_k").alias("rapid_stops"))
    return out.where("local_stops > rapid_stops").withColumn("per_stop", (F.col("local_s") - F.col("rapid_s")) / (F.col("local_stops") - F.col("rapid_stops")))
