"""Operators along a trip's pings. Windows are by trip (and day), ordered by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import search

TRIP = ("day", "trip")


@dataclass(frozen=True)
class StateSettings:
    """Metres, seconds and miles per hour."""

    hold_step: float = 20.0
    hold_seconds: int = 300
    weight_cap: int = 90
    zone_ahead: float = 40.0
    zone_behind: float = 30.0
    moving_mph: int = 5
    bin_metres: float = 100.0
    longest_interval: int = 180
    least_move: float = 0.5


DEFAULT = StateSettings()


def by_trip(*order: str):
    return Window.partitionBy(*TRIP).orderBy(*(order or ("t",)))


def global_trips(days: list[DataFrame]) -> DataFrame:
    """Days in one table, lead vehicles only. A trip is known by (day, trip)."""
    out = days[0]
    for day in days[1:]:
        out = out.unionByName(day)
    return out.where("lead")


def drop_layovers(pings: DataFrame, s: StateSettings = DEFAULT) -> DataFrame:
    """Long holds lose the pings between their first and last.

    A hold is a run of pings of a trip, each at most ``hold_step`` beyond the one before.
    """
    step = F.col("along") - F.lag("along").over(by_trip())
    runs = pings.withColumn("_run", F.sum(F.when(step <= s.hold_step, 0).otherwise(1)).over(by_trip()))
    run = Window.partitionBy(*TRIP, "_run")
    runs = runs.withColumns({"_t0": F.min("t").over(run), "_t1": F.max("t").over(run)})
    inside = (F.col("t") > F.col("_t0")) & (F.col("t") < F.col("_t1")) & (F.col("_t1") - F.col("_t0") >= s.hold_seconds)
    return runs.where(~inside).drop("_run", "_t0", "_t1")


def ping_weights(pings: DataFrame, s: StateSettings = DEFAULT) -> DataFrame:
    """``w``: half the seconds to the ping before and half to the one after, each gap capped, none is 0."""
    gap = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(2 * s.weight_cap))
    before, after = F.col("t") - F.lag("t").over(by_trip()), F.lead("t").over(by_trip()) - F.col("t")
    return pings.withColumn("w", (gap(before) + gap(after)) / F.lit(2.0))


def positions_by_route(points: DataFrame, name: str = "ds") -> DataFrame:
    """One sorted array of distances per route and direction (a route has some hundred at most)."""
    return points.groupBy("route_id", "direction_id").agg(F.sort_array(F.collect_list("d")).alias(name))


def stop_zone_flag(pings: DataFrame, stops: DataFrame, s: StateSettings = DEFAULT) -> DataFrame:
    """``in_zone``: whether some stop of the route is from ``zone_behind`` behind to just under ``zone_ahead`` ahead.

    The first stop that isn't too far behind decides: an as-of look-up by binary search.
    """
    joined = pings.join(positions_by_route(stops, "_ds"), ["route_id", "direction_id"], "left")
    first = F.get("_ds", search.count_below(F.col("_ds"), F.col("along") - s.zone_behind))
    return joined.withColumn("in_zone", F.coalesce(first < F.col("along") + s.zone_ahead, F.lit(False))).drop("_ds")


def state_of(speed: Column, in_zone: Column, s: StateSettings = DEFAULT) -> Column:
    """0 moving, 1 crawling, 2 at a stop, 3 stopped elsewhere."""
    return F.when(speed >= s.moving_mph, 0).when(speed > 0, 1).when(in_zone, 2).otherwise(3)


def ping_states(pings: DataFrame, stops: DataFrame, s: StateSettings = DEFAULT) -> DataFrame:
    """Pings with ``w``, ``in_zone``, ``state``, ``hour`` and ``bin``: what most tables start from."""
    found = stop_zone_flag(ping_weights(pings, s), stops, s)
    return found.withColumns({
        "state": state_of(F.col("average_speed"), F.col("in_zone"), s),
        "hour": F.floor(F.col("t") / 3600).cast("int"),
        "bin": F.floor(F.col("along") / s.bin_metres).cast("int"),
    })


def interval_bins(pings: DataFrame, s: StateSettings = DEFAULT) -> DataFrame:
    """``bin, hour, time, dist``: each interval between pings over the bins it crosses.

    Time goes by distance; an interval with hardly a move is all in its first bin, without distance.
    """
    ends = {"_t1": F.lead("t").over(by_trip()), "_a1": F.lead("along").over(by_trip())}
    rows = pings.withColumns(ends).where((F.col("_t1") > F.col("t")) & (F.col("_t1") - F.col("t") <= s.longest_interval))
    size = F.lit(s.bin_metres)
    first = F.floor(F.col("along") / size)
    last = F.floor(F.greatest(F.col("_a1") - F.lit(1e-6), F.col("along")) / size)
    rows = rows.withColumns({"_dt": (F.col("_t1") - F.col("t")).cast("double"), "_dd": F.greatest(F.col("_a1") - F.col("along"), F.lit(0.0)), "_first": first})
    rows = rows.withColumn("bin", F.explode(F.sequence(first, last)))
    piece = F.greatest(F.least(F.greatest("_a1", "along"), (F.col("bin") + 1) * size) - F.greatest("along", F.col("bin") * size), F.lit(0.0))
    moved = F.col("_dd") > s.least_move
    share = F.when(moved, piece / F.col("_dd")).when(F.col("bin") == F.col("_first"), 1.0).otherwise(0.0)
    return rows.select(
        "route_id", "direction_id", "mode", *TRIP, F.col("bin").cast("int").alias("bin"),
        F.floor((F.col("t") + F.col("_t1")) / 2 / 3600).cast("int").alias("hour"),
        (F.col("_dt") * share).alias("time"), F.when(moved, piece).otherwise(0.0).alias("dist"),
    )


def trip_extents(pings: DataFrame, route_dir: DataFrame) -> DataFrame:
    """One row per trip: route, vehicle, first and last time and distance, share of the route covered."""
    rows = pings.groupBy(*TRIP).agg(
        F.min_by("route_id", "t").alias("route_id"), F.min_by("direction_id", "t").alias("direction_id"), F.min_by("vehicle_id", "t").alias("vehicle_id"),
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("along").alias("a0"), F.max("along").alias("a1"), F.count("*").alias("n"),
    )
    lengths = route_dir.select("route_id", "direction_id", "length", "mode")
    return rows.join(lengths, ["route_id", "direction_id"]).withColumn("cov", (F.col("a1") - F.col("a0")) / F.col("length"))


def stale_repeats(pings: DataFrame, least_mph: int = 2) -> DataFrame:
    """Pings without those that repeat their vehicle's last position while it reports moving."""
    w = Window.partitionBy("day", "vehicle_id").orderBy("t")
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y")) & (F.col("average_speed") > least_mph)
    return pings.withColumn("_stale", F.coalesce(same, F.lit(False))).where("not _stale").drop("_stale")


def position_interp(pings: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, t_at``: when each trip passes distances of its route (``targets``: route_id, direction_id, target).

    Linear between the last ping at or before the distance and the first beyond;
    no row outside the trip. Each ping makes rows for the targets up to the next
    ping, which binary search cuts out of the route's sorted array: no row that isn't a passage.
    """
    w = Window.partitionBy("route_id", "direction_id", *TRIP).orderBy("along", "t")
    by_route = targets.groupBy("route_id", "direction_id").agg(F.sort_array(F.collect_set("target")).alias("_ds"))
    rows = pings.select("route_id", "direction_id", *TRIP, "t", "along", F.lead("along").over(w).alias("_a1"), F.lead("t").over(w).alias("_t1")).join(by_route, ["route_id", "direction_id"])
    passed = F.when(F.col("_a1").isNull(), search.between(F.col("_ds"), F.col("along"), F.col("along"))).otherwise(search.between(F.col("_ds"), F.col("along"), F.col("_a1"), high_too=False))
    rows = rows.withColumn("target", F.explode(passed))
    share = (F.col("target") - F.col("along")) / (F.col("_a1") - F.col("along"))
    at = F.when(F.col("along") == F.col("target"), F.col("t").cast("double")).otherwise(F.col("t") + (F.col("_t1") - F.col("t")) * share)
    return rows.select("route_id", "direction_id", *TRIP, "target", at.alias("t_at"))


def covering_trips(extents: DataFrame, points: DataFrame, key: str, before: float, after: float) -> DataFrame:
    """``points`` (route_id, direction_id, ``key``, d) with ``trips``: how many run from ``before`` metres before the point to ``after`` metres beyond it.

    A sweep: a trip opens at the first point that it covers and closes after the
    last, found by binary search. Two rows per trip go into sums by point, and the
    running sum is over a route's points alone; no trip meets each of its points.
    """
    keys = ("route_id", "direction_id")
    by_route = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", key))).alias("_p"))
    span = extents.select(*keys, "a0", "a1").join(by_route, list(keys))
    span = span.select(*keys, search.count_below(F.col("_p"), F.col("a0") + before, "d").alias("_i"), search.count_up_to(F.col("_p"), F.col("a1") - after, "d").alias("_j"))
    steps = span.where("_i < _j").select(*keys, F.inline(F.array(F.struct(F.col("_i").alias("_at"), F.lit(1).alias("_by")), F.struct(F.col("_j").alias("_at"), F.lit(-1).alias("_by")))))
    steps = steps.groupBy(*keys, "_at").agg(F.sum("_by").alias("_by"))
    numbered = by_route.select(*keys, F.posexplode("_p").alias("_at", "_p")).select(*keys, "_at", f"_p.{key}", "_p.d")
    swept = numbered.join(steps, [*keys, "_at"], "left")
    trips = F.coalesce(F.sum("_by").over(Window.partitionBy(*keys).orderBy("_at")), F.lit(0))
    return swept.select(*keys, key, "d", trips.alias("trips"))


def headways(passages: DataFrame, longest: float = 1800.0, least: int = 3) -> DataFrame:
    """Per point and hour: gaps between passages, their mean, and the wait of who comes at random.

    ``passages``: day, point, t_at. Days don't mix.
    """
    w = Window.partitionBy("day", "point").orderBy("t_at")
    gaps = passages.withColumn("h", F.lead("t_at").over(w) - F.col("t_at")).where(F.col("h") < longest)
    hours = gaps.groupBy("point", F.floor(F.col("t_at") / 3600).cast("int").alias("hour"))
    return hours.agg(F.count("*").alias("n"), F.avg("h").alias("mean_gap"), (F.avg(F.col("h") * F.col("h")) / (2 * F.avg("h"))).alias("wait")).where(F.col("n") >= least)
