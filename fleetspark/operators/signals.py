"""Waits at signals: positions along routes, then the signal ahead of each slow ping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import search
from fleetspark.operators.matching import near_points
from fleetspark.operators.states import covering_trips

KEY = ("route_id", "direction_id")


def signal_positions(signals: DataFrame, shapes: DataFrame, route_dir: DataFrame, radius: float = 20.0, margin: float = 150.0, tunnels: DataFrame | None = None) -> DataFrame:
    """``route_id, direction_id, signal_id, d``: signals on a shape, at its nearest point, away from its ends.

    Signals over one of ``tunnels`` (route_id, direction_id, d0, d1) are left out.
    """
    points = shapes.select(*KEY, F.col("x").alias("px"), F.col("y").alias("py"), "d")
    best = near_points(signals.select("signal_id", "x", "y"), points, radius).groupBy(*KEY, "signal_id").agg(F.min(F.struct("off", "d")).alias("b"))
    rows = best.select(*KEY, "signal_id", F.col("b.d").alias("d")).join(route_dir.select(*KEY, "length"), list(KEY))
    rows = rows.where((F.col("d") > margin) & (F.col("d") < F.col("length") - margin)).drop("length")
    if tunnels is None:
        return rows
    below = tunnels.select(*(F.col(k).alias(f"_{k}") for k in KEY), "d0", "d1")
    return rows.join(below, [F.col(k) == F.col(f"_{k}") for k in KEY] + [F.col("d").between(F.col("d0"), F.col("d1"))], "left_anti")


def at_signals(states: DataFrame, positions: DataFrame, up: float = 75.0, down: float = 12.0) -> DataFrame:
    """``states`` with ``signal_id``: pings in the queue of a signal.

    A ping's signal is the first that is at most ``down`` behind it, if it is at
    most ``up`` ahead: an as-of look-up by binary search in the route's sorted array.
    """
    by_route = positions.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("d", "signal_id"))).alias("_s"))
    rows = states.join(by_route, list(KEY)).withColumn("_f", F.get("_s", search.count_below(F.col("_s"), F.col("along") - down, "d")))
    return rows.where(F.col("_f.d") - F.col("along") <= up).withColumn("signal_id", F.col("_f.signal_id")).drop("_s", "_f")


WAITS = "state IN (1, 3)"


def signal_waits(states: DataFrame, extents: DataFrame, positions: DataFrame, up: float = 75.0, down: float = 12.0, slack: float = 5.0) -> DataFrame:
    """Per approach: seconds waited, seconds at a stop just before it, and trips that passed (counted by a sweep)."""
    waits = at_signals(states, positions, up, down).groupBy(*KEY, "signal_id").agg(
        F.sum(F.when(F.expr(WAITS), F.col("w")).otherwise(0.0)).alias("wait"), F.sum(F.when(F.col("state") == 2, F.col("w")).otherwise(0.0)).alias("near_side"),
    )
    passes = covering_trips(extents, positions, "signal_id", up - slack, down - slack).where("trips > 0").withColumnRenamed("trips", "passes")
    out = passes.join(waits, [*KEY, "signal_id"], "left")
    return out.select(*KEY, "signal_id", "d", "passes", F.coalesce("wait", F.lit(0.0)).alias("wait"), F.coalesce("near_side", F.lit(0.0)).alias("near_side"))


def signal_hours(states: DataFrame, positions: DataFrame, waits: DataFrame, days: int = 1) -> DataFrame:
    """``signal_id, hour, hours``: hours a day that vehicles wait at each signal in each clock hour (0 to 23), at approaches that trips pass."""
    rows = at_signals(states, positions).where(WAITS).join(waits.select(*KEY, "signal_id"), [*KEY, "signal_id"], "left_semi")
    hour = F.least(F.greatest("hour", F.lit(0)), F.lit(23)).alias("hour")
    return rows.groupBy("signal_id", hour).agg((F.sum("w") / 3600.0 / days).alias("hours"))


def signal_totals(waits: DataFrame, route_dir: DataFrame, days: int = 1) -> DataFrame:
    """Per signal that holds vehicles: hours a day waited, in all and of buses and rail, hours at stops before it, passes a day, seconds a pass."""
    rows = waits.join(route_dir.select(*KEY, "mode"), list(KEY))
    own = lambda c: F.sum(c) / 3600.0 / days
    of = lambda mode: own(F.when(F.col("mode") == mode, F.col("wait")).otherwise(0.0)).alias(f"{mode}_hours")
    found = rows.groupBy("signal_id").agg(own(F.col("wait")).alias("hours"), own(F.col("near_side")).alias("near_hours"), (F.sum("passes") / F.lit(float(days))).alias("passes"), (F.sum("wait") / F.sum("passes")).alias("wait"), of("bus"), of("rail"))
    return found.where("hours > 0")


def signal_ranking(totals: DataFrame, by: str = "hours", least_passes: float = 40.0, least_hours: float = 0.005, top: int = 20) -> DataFrame:
    """Signals ranked by ``hours``, or by the mean ``wait`` of those with enough passes; ``share``: what the ``top`` have of all hours.

    One row per signal with a wait, some thousand in a city, so one task ranks them.
    """
    rows = totals.where(F.col("hours") > least_hours)
    rows = rows.where(F.col("passes") >= least_passes) if by == "wait" else rows
    order = Window.orderBy(F.desc(F.round(by, 6)), "signal_id")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    all_ = Window.partitionBy(F.lit(0))
    share = F.sum(F.when(F.col("rank") <= top, F.col("hours"))).over(all_) / F.sum("hours").over(all_)
    return ranked.select("signal_id", "rank", "hours", "wait", "passes", share.alias("share"))


def signal_topk(waits: DataFrame, approaches: int = 8) -> DataFrame:
    """The approaches of each signal with the longest waits, ranked."""
    w = Window.partitionBy("signal_id").orderBy(F.desc(F.round("wait", 6)), *KEY)
    return waits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= approaches).select("signal_id", "rank", *KEY, "wait")


def signals_seen(waits: DataFrame, hours: DataFrame, route_dir: DataFrame, mode: str | None = None, hour: int | None = None, days: int = 1, approaches: int = 8) -> DataFrame:
    """``signal_id, hours, wait, passes`` of signals that hold vehicles, for one mode or all, in one clock hour or the whole day.

    ``waits``: see ``signal_waits``; ``hours``: see ``signal_hours``. Seconds a
    pass and passes a day are those of the mode's among a signal's first
    ``approaches``. An hour's figure is not kept by mode: it is shared out as the
    signal's whole day is. ``signal_ranking`` ranks the result; a fair mean wait needs 40 passes, or 3 where one hour is looked at.
    """
    rows = waits.join(route_dir.select(*KEY, "mode"), list(KEY))
    mine = F.lit(True) if mode is None else F.col("mode") == mode
    best = Window.partitionBy("signal_id").orderBy(F.desc(F.round("wait", 6)), *KEY)
    rows = rows.withColumn("_rank", F.row_number().over(best))
    shown = mine & (F.col("_rank") <= approaches)
    found = rows.groupBy("signal_id").agg(F.sum("wait").alias("_all"), F.sum(F.when(mine, F.col("wait"))).alias("_own"), F.sum(F.when(shown, F.col("passes"))).alias("_passes"), F.sum(F.when(shown, F.col("wait"))).alias("_wait"))
    found = found.where("_all > 0").withColumn("_share", F.coalesce("_own", F.lit(0.0)) / F.col("_all"))
    if hour is None:
        found = found.withColumn("hours", F.coalesce("_own", F.lit(0.0)) / 3600.0 / days)
    else:
        at = hours.where(F.col("hour") == hour).select("signal_id", F.col("hours").alias("_at"))
        found = found.join(at, "signal_id", "left").withColumn("hours", F.coalesce("_at", F.lit(0.0)) * F.col("_share"))
    return found.select("signal_id", "hours", F.coalesce(F.col("_wait") / F.col("_passes"), F.lit(0.0)).alias("wait"), (F.coalesce("_passes", F.lit(0)) / F.lit(float(days))).alias("passes"))
