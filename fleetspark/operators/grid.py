"""Tables of time and speed by route, direction, bin and hour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import search
from fleetspark.functions.quantiles import quantile
from fleetspark.operators.states import covering_trips

MPS = 2.23694
CELL = ("route_id", "direction_id", "bin", "hour")
STATES = (0, 1, 2, 3)


@dataclass(frozen=True)
class GridSettings:
    """Hours kept, trips that a cell needs, and limits of the reference speed in mph."""

    first_hour: int = 5
    last_hour: int = 23
    least_trips: int = 3
    slowest: float = 8.0
    fastest: float = 30.0
    fastest_rail: float = 50.0
    bin_metres: float = 100.0
    full_cover: float = 0.85
    least_runs: int = 2


DEFAULT = GridSettings()


def speed_grid(contributions: DataFrame, s: GridSettings = DEFAULT) -> DataFrame:
    """Seconds, metres, trips and speed (m/s, null without time) of each cell.

    Trips are summed first, so that counting them needs no second expansion.
    """
    per_trip = contributions.where(F.col("hour").between(s.first_hour, s.last_hour)).groupBy(*CELL, "mode", "day", "trip").agg(F.sum("time").alias("time"), F.sum("dist").alias("dist"))
    cells = per_trip.groupBy(*CELL, "mode").agg(F.sum("time").alias("time"), F.sum("dist").alias("dist"), F.count("*").alias("trips"))
    return cells.withColumn("speed", F.when(F.col("time") > 0, F.col("dist") / F.col("time")))


def reference_speed(grid: DataFrame, s: GridSettings = DEFAULT, sketch: int = 0) -> DataFrame:
    """Free-flow speed of each bin: the 90th percentile over busy enough hours, within limits; see ``quantiles.quantile`` for ``sketch``."""
    top = F.when(F.col("mode") == "rail", s.fastest_rail / MPS).otherwise(s.fastest / MPS)
    found = grid.where((F.col("trips") >= s.least_trips) & F.col("speed").isNotNull()).groupBy("route_id", "direction_id", "bin", "mode").agg(quantile("speed", 0.9, sketch).alias("p90"))
    return found.select("route_id", "direction_id", "bin", F.least(F.greatest("p90", F.lit(s.slowest / MPS)), top).alias("vref"))


def delay_grid(grid: DataFrame, reference: DataFrame) -> DataFrame:
    """The grid with ``vref`` and ``delay``: seconds over those at free flow; null without a reference."""
    late = F.greatest(F.col("time") - F.col("dist") / F.col("vref"), F.lit(0.0))
    return grid.join(reference, ["route_id", "direction_id", "bin"], "left").withColumn("delay", F.when(F.col("vref").isNotNull(), late))


def heat_cells(delays: DataFrame, route_dir: DataFrame, s: GridSettings = DEFAULT) -> DataFrame:
    """Cells to show: mph, trips and delay per trip, inside the route, with enough trips."""
    rows = delays.join(route_dir.select("route_id", "direction_id", "length"), ["route_id", "direction_id"])
    rows = rows.where((F.col("trips") >= s.least_trips) & (F.col("time") > 0) & (F.col("bin") < F.ceil(F.col("length") / s.bin_metres)))
    return rows.select(*CELL, (F.col("speed") * MPS).alias("mph"), "trips", (F.col("delay") / F.col("trips")).alias("delay_per_trip"))


def bin_traversals(extents: DataFrame, s: GridSettings = DEFAULT) -> DataFrame:
    """How many trips cover each bin.

    A sweep: a trip is one more at its first bin and one less after its last.
    These steps are summed by bin first, so what is left is as long as the route,
    however many trips there are.
    """
    first, last = F.floor(F.col("a0") / s.bin_metres).cast("int"), F.least(F.floor(F.col("a1") / s.bin_metres), F.ceil(F.col("length") / s.bin_metres)).cast("int")
    ends = F.array(F.struct(first.alias("bin"), F.lit(1).alias("_by")), F.struct((last + 1).alias("bin"), F.lit(-1).alias("_by")))
    steps = extents.where(first <= last).select("route_id", "direction_id", F.inline(ends)).groupBy("route_id", "direction_id", "bin").agg(F.sum("_by").alias("_by"))
    along = Window.partitionBy("route_id", "direction_id").orderBy("bin")
    level = steps.select("route_id", "direction_id", "bin", F.sum("_by").over(along).alias("traversals"), (F.lead("bin").over(along) - 1).alias("_to")).where("traversals > 0")
    return level.select("route_id", "direction_id", F.explode(F.sequence("bin", "_to")).alias("bin"), "traversals")


def _by_state(states: DataFrame, *keys: str) -> DataFrame:
    sums = [F.coalesce(F.sum(F.when(F.col("state") == k, F.col("w"))), F.lit(0.0)).alias(f"s{k}") for k in STATES]
    return states.groupBy(*keys).agg(*sums)


def budget_by_bin(states: DataFrame, traversals: DataFrame) -> DataFrame:
    """Seconds per traversal in each state, by bin."""
    rows = _by_state(states, "route_id", "direction_id", "bin").join(traversals, ["route_id", "direction_id", "bin"])
    return rows.select("route_id", "direction_id", "bin", *[(F.col(f"s{k}") / F.col("traversals")).alias(f"s{k}") for k in STATES])


def budget_by_hour(states: DataFrame, s: GridSettings = DEFAULT) -> DataFrame:
    """Share of time in each state, by route, direction and hour."""
    rows = _by_state(states.where(F.col("hour").between(s.first_hour, s.last_hour)), "route_id", "direction_id", "hour")
    total = sum((F.col(f"s{k}") for k in STATES), F.lit(0.0))
    return rows.where(total > 0).select("route_id", "direction_id", "hour", *[(F.col(f"s{k}") / total).alias(f"s{k}") for k in STATES])


def runtime_by_hour(extents: DataFrame, s: GridSettings = DEFAULT, sketch: int = 0) -> DataFrame:
    """Minutes from end to end by departure hour: median, 90th percentile, number of nearly whole trips."""
    minutes = (F.col("t1") - F.col("t0")) / F.lit(60.0) / F.col("cov")
    full = extents.where(F.col("cov") >= s.full_cover).withColumns({"hour": F.floor(F.col("t0") / 3600).cast("int"), "minutes": minutes})
    rows = full.where(F.col("hour").between(s.first_hour, s.last_hour)).groupBy("route_id", "direction_id", "hour")
    rows = rows.agg(quantile("minutes", 0.5, sketch).alias("median"), quantile("minutes", 0.9, sketch).alias("p90"), F.count("*").alias("n"))
    return rows.where(F.col("n") >= s.least_runs)


def runtime_beside_schedule(observed: DataFrame, scheduled: DataFrame) -> DataFrame:
    """``observed`` (see ``runtime_by_hour``) and ``scheduled`` (route_id, direction_id, hour, runtime in seconds) side by side: all hours that either has."""
    plan = scheduled.select("route_id", "direction_id", "hour", (F.col("runtime") / 60.0).alias("planned"))
    return observed.join(plan, ["route_id", "direction_id", "hour"], "full").select("route_id", "direction_id", "hour", "median", "p90", "n", "planned")


def stop_dwell(states: DataFrame, extents: DataFrame, stops: DataFrame, ahead: float = 40.0, behind: float = 30.0, slack: float = 5.0) -> DataFrame:
    """Per stop: chance that a passing trip halts in its zone, and its seconds stopped; null at the ends.

    The zone is from ``ahead`` before the stop to ``behind`` after it. Passing
    trips are counted by a sweep. Pings that stand find the stops whose zone they
    are in by binary search, and count where their trip runs through the zone.
    """
    keys = ("route_id", "direction_id")
    ends = Window.partitionBy(*keys)
    rows = stops.withColumn("_end", (F.col("d") == F.min("d").over(ends)) | (F.col("d") == F.max("d").over(ends)))
    passing = covering_trips(extents, stops, "stop_id", ahead - slack, behind - slack).select(*keys, "stop_id", F.col("trips").alias("traversals"))
    by_route = stops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "stop_id"))).alias("_stops"))
    halts = states.where("average_speed = 0").select(*keys, "day", "trip", "along", "w").join(by_route, list(keys))
    halts = halts.withColumn("_s", F.explode(search.between(F.col("_stops"), F.col("along") - behind, F.col("along") + ahead, "d")))
    halts = halts.groupBy(*keys, "day", "trip", F.col("_s.stop_id").alias("stop_id"), F.col("_s.d").alias("d")).agg(F.sum("w").alias("_sec"))
    halts = halts.join(extents.select(*keys, "day", "trip", "a0", "a1"), [*keys, "day", "trip"])
    halts = halts.where((F.col("a0") <= F.col("d") - ahead + slack) & (F.col("a1") >= F.col("d") + behind - slack))
    found = halts.groupBy(*keys, "stop_id").agg(F.count("*").alias("halts"), F.sum("_sec").alias("sec"))
    out = rows.join(passing, [*keys, "stop_id"], "left").join(found, [*keys, "stop_id"], "left")
    middle = ~F.col("_end") & (F.coalesce("traversals", F.lit(0)) > 0)
    share = lambda c, none: F.when(middle, F.coalesce(c, F.lit(none)) / F.col("traversals"))
    return out.select(*keys, "stop_id", "d", share("halts", 0).alias("p"), share("sec", 0.0).alias("stopped"))


def fleet_budget(states: DataFrame, days: int = 1) -> DataFrame:
    """Vehicle-hours a day in each state by mode and hour, and for all modes together."""
    rows = states.where("hour between 0 and 24")
    sums = [(F.coalesce(F.sum(F.when(F.col("state") == k, F.col("w"))), F.lit(0.0)) / 3600.0 / days).alias(f"s{k}") for k in STATES]
    found = rows.groupingSets([["mode", "hour"], ["hour"]], "mode", "hour").agg(*sums)
    return found.withColumn("mode", F.coalesce("mode", F.lit("all")))


def observed_routes(extents: DataFrame, route_dir: DataFrame, days: int = 1, least: int = 3) -> DataFrame:
    """Routes with enough trips a day."""
    rows = extents.groupBy("route_id", "direction_id").agg(F.count("*").alias("trips")).where(F.col("trips") >= least * days)
    return rows.join(route_dir.select("route_id", "direction_id", "mode", "length", "shape_id"), ["route_id", "direction_id"]).withColumn("trips_per_day", F.col("trips") / F.lit(float(days)))


def slow_stretches(heat: DataFrame, least_bins: int = 3, below: float = 6.0) -> DataFrame:
    """Runs of neighbouring bins of one speed class, long and slow enough."""
    from fleetspark.functions.scalars import SPEED_EDGES, class_by_edges

    w = Window.partitionBy("route_id", "direction_id", "hour").orderBy("bin")
    rows = heat.withColumn("class", class_by_edges(F.col("mph"), SPEED_EDGES))
    breaks = F.when((F.col("bin") - F.lag("bin").over(w) == 1) & (F.col("class") == F.lag("class").over(w)), 0).otherwise(1)
    rows = rows.withColumn("_break", breaks).withColumn("_island", F.sum("_break").over(w))
    found = rows.groupBy("route_id", "direction_id", "hour", "_island").agg(F.min("bin").alias("bin0"), F.max("bin").alias("bin1"), F.count("*").alias("bins"), F.avg("mph").alias("mph"))
    return found.where((F.col("bins") >= least_bins) & (F.col("mph") < below)).drop("_island")


def trip_traces(states: DataFrame) -> DataFrame:
    """Per trip its (t, along, state) in order."""
    return states.groupBy("day", "trip").agg(F.array_sort(F.collect_list(F.struct("t", "along", "state"))).alias("trace"))
