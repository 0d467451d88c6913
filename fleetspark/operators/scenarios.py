"""Tables on top of the grids: hotspots, segment times, transfers and removed stops."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.grid import MPS
from fleetspark.operators.matching import near_points

KEY = ("route_id", "direction_id")


def hotspots(delays: DataFrame, shapes: DataFrame, cell: float = 150.0, ends: float = 300.0, least_hours: float = 0.5, top: int = 600, bin_metres: float = 100.0, days: int = 1) -> DataFrame:
    """Square cells with the most delay: hours a day, the delay's centre, how many routes, hours of buses.

    Bins near a route's ends don't count. A bin is at its middle point.
    """
    middle = F.floor(F.col("d") / bin_metres)
    length = shapes.groupBy(*KEY).agg(F.max("d").alias("_end"))
    points = shapes.where((F.col("d") - middle * bin_metres) == bin_metres / 2).select(*KEY, middle.cast("int").alias("bin"), "x", "y", "d").join(length, list(KEY))
    points = points.where((F.col("d") >= ends) & (F.col("d") <= F.col("_end") + 10 - ends))
    per_bin = delays.where("delay is not null").groupBy(*KEY, "mode", "bin").agg(F.sum("delay").alias("delay"))
    rows = per_bin.join(points, [*KEY, "bin"]).withColumn("_w", F.col("delay") + F.lit(1e-6))
    cells = rows.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(
        (F.sum("delay") / 3600.0 / days).alias("hours"), (F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("lon_x"), (F.sum(F.col("y") * F.col("_w")) / F.sum("_w")).alias("lat_y"),
        F.countDistinct("route_id").alias("routes"), (F.sum(F.when(F.col("mode") == "bus", F.col("delay")).otherwise(0.0)) / 3600.0 / days).alias("bus_hours"),
    )
    return cells.where(F.col("hours") >= least_hours).orderBy(F.desc(F.round("hours", 6)), "cx", "cy").limit(top)


def segment_minutes(parts: DataFrame, heat: DataFrame, key: str, hours: Iterable[int] = range(5, 24), first_hour: int = 5, last_hour: int = 23, slow_mph: float = 7.0, bin_metres: float = 100.0) -> DataFrame:
    """Minutes over [d0, d1] of a route in each of ``hours``, from its display cells (``grid.heat_cells``).

    Every bin counts: one without a cell, or whose cell stands still, goes at
    ``slow_mph``. The grid has all hours from ``first_hour`` to ``last_hour``,
    with cells or without, so a quiet hour is slow throughout and borrows from
    none. An hour outside takes the grid's next one, else the one before; further out all is slow.
    """
    first, last = F.floor(F.col("d0") / bin_metres), F.floor((F.col("d1") - F.lit(1e-6)) / bin_metres)
    source = {h: next((x for x in (h, h + 1, h - 1) if first_hour <= x <= last_hour), None) for h in hours}
    asked = F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(x).cast("int").alias("_from")) for h, x in source.items()])
    rows = parts.select(key, *[c for c in KEY if c != key], "d0", "d1", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("bin")).select("*", F.inline(asked))
    metres = F.least(F.col("bin") * F.lit(bin_metres) + bin_metres, F.col("d1")) - F.greatest(F.col("bin") * F.lit(bin_metres), F.col("d0"))
    rows = rows.join(heat.select(*KEY, "bin", F.col("hour").alias("_from"), "mph"), [*KEY, "bin", "_from"], "left")
    speed = F.when(F.col("mph") > 0, F.col("mph")).otherwise(F.lit(slow_mph)) / MPS
    return rows.groupBy(key, "hour").agg((F.sum(metres / speed) / 60.0).alias("minutes"))


def nearby_families(stops: DataFrame, key: str, radius: float = 120.0) -> DataFrame:
    """Per stop the other families with a stop nearer than ``radius``."""
    other = stops.select(F.col("family").alias("other"), F.col("x").alias("px"), F.col("y").alias("py"))
    return near_points(stops, other, radius).where("other <> family").groupBy(key).agg(F.array_sort(F.collect_set("other")).alias("families"))


def stop_removal_impact(dwell: DataFrame, seconds: float = 12.0) -> DataFrame:
    """``dwell`` with ``removed``: the walk to the nearest kept stop, and the seconds a trip saves by not halting."""
    w = Window.partitionBy(*KEY).orderBy("d")
    kept = F.when(~F.col("removed"), F.col("d"))
    before = F.last(kept, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(kept, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    far = F.lit(1e9)
    walk = F.least(F.coalesce(F.col("d") - before, far), F.coalesce(after - F.col("d"), far))
    saved = F.when(F.col("removed"), F.coalesce("p", F.lit(0.0)) * seconds).otherwise(0.0)
    return dwell.select(*KEY, "stop_id", "removed", F.when(F.col("removed"), walk).alias("walk"), saved.alias("saved"))


def near_hours(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` (keys, hour, values) with the hours that have none taken from the next hour, else from the one before."""
    shifts = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(by).alias("by")) for k, by in enumerate((0, -1, 1))])
    spread = rows.withColumn("_s", F.explode(shifts)).withColumn("hour", F.col("hour") + F.col("_s.by"))
    best = spread.groupBy(*keys, "hour").agg(F.min_by(F.struct(*values), "_s.rank").alias("_v"))
    return best.select(*keys, "hour", *[F.col(f"_v.{v}").alias(v) for v in values])


def corridor_truncation(cut_in: DataFrame, cut_out: DataFrame, service: DataFrame, turn: float = 4.0, recovery: float = 1.12, first_hour: int = 5, last_hour: int = 23) -> DataFrame:
    """What ending routes before a corridor saves, by route and hour.

    ``cut_in``, ``cut_out``: route_id, hour, minutes of running time cut.
    ``service``: route_id, hour, tph (trips an hour), round_trip (minutes of both
    directions). ``turn``: minutes to turn round at the new end. Hours that
    ``segment_minutes`` wasn't asked for have no row. Gives the minutes saved a round trip, old and new headway, buses, buses freed, and the bus-hours
    that the route saves a day, which as in the reference is the grid's, from ``first_hour`` to ``last_hour``.
    """
    rows = service.join(cut_in.withColumnRenamed("minutes", "cut_in"), ["route_id", "hour"]).join(cut_out.withColumnRenamed("minutes", "cut_out"), ["route_id", "hour"])
    rows = rows.where("tph > 0").withColumn("saved", F.greatest(F.col("cut_in") + F.col("cut_out") - turn, F.lit(0.0)))
    rows = rows.withColumns({"headway": 60.0 / F.col("tph"), "cycle": F.col("round_trip") * recovery})
    rows = rows.withColumns({"buses": F.col("cycle") / F.col("headway"), "new_headway": F.col("headway") * (F.col("cycle") - F.col("saved")) / F.col("cycle"), "freed": F.col("saved") / F.col("headway")})
    day = F.sum(F.when(F.col("hour").between(first_hour, last_hour), F.col("tph") * F.col("saved") / 60.0)).over(Window.partitionBy("route_id"))
    return rows.withColumn("daily_hours", F.coalesce(day, F.lit(0.0))).select("route_id", "hour", "saved", "headway", "new_headway", "buses", "freed", "daily_hours")


def transfer_rides(bus: DataFrame, observed: DataFrame, scheduled: DataFrame, headways: DataFrame, walk: float = 3.0, penalty: float = 5.0) -> DataFrame:
    """Riders who change to rail against staying on the bus, in minutes.

    ``bus``: route_id, pair, hour, median, p90. ``observed`` rail: pair, hour,
    median, per_hour. ``scheduled`` rail: pair, hour, trips, median. ``headways``:
    route_id, hour, headway, new_headway. A pair that either rail table has
    counts: the ride is as observed, else as scheduled; trains an hour are as
    scheduled, else as observed, for one day sees too few of those that run part
    of the way. Without headways nobody gains a shorter wait.
    """
    seen = observed.select("pair", "hour", F.col("median").alias("seen"), "per_hour")
    plan = scheduled.select("pair", "hour", F.col("median").alias("planned"), F.col("trips").cast("double").alias("trips"))
    rail = seen.join(plan, ["pair", "hour"], "full").select("pair", "hour", F.coalesce("seen", "planned").alias("ride"), "planned", F.col("seen").isNotNull().alias("measured"), F.coalesce("trips", "per_hour").alias("trains"))
    rows = bus.select("route_id", "pair", "hour", F.col("median").alias("stay"), F.col("p90").alias("stay_p90")).join(rail, ["pair", "hour"])
    rows = rows.join(headways.select("route_id", "hour", "headway", "new_headway"), ["route_id", "hour"], "left")
    rows = rows.withColumns({"wait": 30.0 / F.col("trains"), "gain": F.coalesce((F.col("headway") - F.col("new_headway")) / 2, F.lit(0.0))})
    rows = rows.withColumn("via", walk + F.col("wait") + F.col("ride") + penalty)
    return rows.select("route_id", "pair", "hour", "stay", "stay_p90", "ride", "planned", "measured", "trains", "wait", "via", "gain", (F.col("via") - F.col("gain") - F.col("stay")).alias("net"))


def trunk_transfer(portals: DataFrame, rides: DataFrame, pairs: DataFrame, lines: DataFrame, goal: str, per_hour: float, walk: float = 2.0, spread: float = 0.3) -> DataFrame:
    """Each line's trip to ``goal`` today, and by a transfer to a trunk line with ``per_hour`` trains, typical and bad.

    ``portals``: route_id, hour, median, p90, free_flow. ``rides``: route_id,
    station, hour, median, p90 from before the portal. ``pairs``: pair
    ("a|b"), hour, median, p90. ``lines``: route_id, transfer. An hour without
    figures takes the next one's, else the one's before.
    """
    both = ["median", "p90"]
    own = near_hours(portals, ["route_id"], [*both, "free_flow"]).select("route_id", "hour", F.col("median").alias("_a"), F.col("p90").alias("_a9"), "free_flow")
    near = near_hours(rides, ["route_id", "station"], both)
    today = near.where(F.col("station") == goal).select("route_id", "hour", F.col("median").alias("today"), F.col("p90").alias("today_p90"))
    leg = near.select("route_id", F.col("station").alias("transfer"), "hour", F.col("median").alias("_l"), F.col("p90").alias("_l9"))
    onward = near_hours(pairs, ["pair"], both).select("pair", "hour", F.col("median").alias("_r"), F.col("p90").alias("_r9"))
    rows = own.join(today, ["route_id", "hour"]).join(lines, "route_id").join(leg, ["route_id", "transfer", "hour"], "left")
    rows = rows.withColumn("pair", F.concat_ws("|", "transfer", F.lit(goal))).join(onward, ["pair", "hour"])
    headway = 60.0 / per_hour
    over = lambda a, b: F.greatest(F.coalesce(F.col(a) - F.col(b), F.lit(0.0)), F.lit(0.0))
    via = F.col("free_flow") + over("_l", "_a") + walk + headway / 2 * (1 + spread * spread) + F.col("_r")
    bad = F.col("free_flow") + over("_l9", "_a9") + walk + headway + F.col("_r9")
    return rows.select("route_id", "hour", over("_a", "free_flow").alias("merge"), "today", "today_p90", via.alias("via"), bad.alias("via_bad"))


def crossing_families(stops: DataFrame, radius: float = 120.0) -> DataFrame:
    """Per stop the families that cross there: those near it, but not near the stop before or after it on its route.

    ``stops``: route_id, direction_id, family, stop_id, d, x, y.
    """
    near = nearby_families(stops, "stop_id", radius)
    w = Window.partitionBy(*KEY).orderBy("d", "stop_id")
    none = F.array().cast("array<string>")
    rows = stops.select(*KEY, "stop_id", "d").join(near, "stop_id", "left").withColumn("_f", F.coalesce("families", none))
    beside = F.concat(F.coalesce(F.lag("_f").over(w), none), F.coalesce(F.lead("_f").over(w), none))
    return rows.withColumn("_beside", beside).select(*KEY, "stop_id", F.array_except("_f", "_beside").alias("transfers"))


def stop_removal_savings(stops: DataFrame, dwell: float = 20.0, lost: float = 18.0) -> DataFrame:
    """``before, after, saved`` by route and direction: halts a trip and the seconds it saves without the ``removed`` stops.

    ``stops``: route_id, direction_id, d, stopped (seconds a trip; null counts as
    a sure halt), removed. A halt takes ``dwell`` seconds and its braking and
    doors ``lost``. Half of a removed stop's riders go to the kept stop before it
    and half to the one after. The ends of a route aren't counted.
    """
    w = Window.partitionBy(*KEY).orderBy("d")
    whole = Window.partitionBy(*KEY)
    kept = F.when(~F.col("removed"), F.col("d"))
    rows = stops.withColumn("_p", F.coalesce(F.least(F.lit(1.0), F.col("stopped") / dwell), F.lit(1.0)))
    rows = rows.withColumns({"_u": F.last(kept, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_w": F.first(kept, True).over(w.rowsBetween(1, Window.unboundedFollowing)), "_end": (F.col("d") == F.min("d").over(whole)) | (F.col("d") == F.max("d").over(whole))})
    moved = rows.where("removed").select(*KEY, F.explode(F.array("_u", "_w")).alias("d"), F.log(1.0 - F.col("_p") / 2).alias("_l")).where("d is not null").groupBy(*KEY, "d").agg(F.sum("_l").alias("_l"))
    rows = rows.join(moved, [*KEY, "d"], "left")
    new = 1.0 - (1.0 - F.col("_p")) * F.exp(F.coalesce("_l", F.lit(0.0)))
    counted = rows.groupBy(*KEY).agg(F.sum(F.when(~F.col("_end"), F.col("_p")).otherwise(0.0)).alias("before"), F.sum(F.when(~F.col("_end") & ~F.col("removed"), new).otherwise(0.0)).alias("after"))
    return counted.withColumn("saved", (F.col("before") - F.col("after")) * lost)


def hotspot_places(delays: DataFrame, states: DataFrame, points: DataFrame, tunnels: DataFrame, stops: DataFrame, cell: float = 150.0, ends: float = 300.0, least_hours: float = 0.5, top: int = 600, width: float = 100.0, days: int = 1) -> DataFrame:
    """Places with the most delay: cells by square, heading (eighths) and whether underground, with the causes.

    ``delays``: bins with delay and mode. ``states``: route_id, direction_id, bin,
    s1, s2, s3 (seconds crawling, at stops, stopped). ``points``: every shape's
    points with bearing. ``tunnels``: route_id, direction_id, d0, d1. ``stops``:
    stop_id, name, x, y, underground. A bin is at its middle; those near a
    route's ends don't count. Hours are a day's, shares are of all slow seconds.
    ``by_mode`` maps modes with delay to their hours, ``routes`` modes to their
    routes. ``name`` is that of ``nearest_stop``.
    """
    end = points.groupBy(*KEY).agg(F.max("d").alias("_end"))
    middle = F.floor(F.col("d") / width)
    at = points.where(F.col("d") - middle * width == width / 2).select(*KEY, middle.cast("int").alias("bin"), "x", "y", "d", "bearing").join(end, list(KEY))
    at = at.where((F.col("bin") * width >= ends) & ((F.col("bin") + 1) * width <= F.col("_end") + 10 - ends))
    at = at.join(tunnels.select(*KEY, "d0", "d1"), list(KEY), "left").withColumn("underground", F.coalesce(F.col("d").between(F.col("d0"), F.col("d1")), F.lit(False)))
    rows = delays.where("delay is not null").groupBy(*KEY, "mode", "bin").agg(F.sum("delay").alias("delay")).join(at, [*KEY, "bin"]).join(states.select(*KEY, "bin", "s1", "s2", "s3"), [*KEY, "bin"], "left")
    rows = rows.withColumn("_w", F.col("delay") + F.lit(1e-6)).na.fill(0.0, ["s1", "s2", "s3"])
    heading = F.pmod(F.floor((F.col("bearing") + 22.5) / 45.0), F.lit(8)).cast("int")
    place = [F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), heading.alias("heading"), F.col("underground")]
    modes = rows.groupBy(*place, "mode").agg(
        *[F.sum(c).alias(c) for c in ("delay", "_w", "s1", "s2", "s3")], F.sum(F.col("x") * F.col("_w")).alias("_x"), F.sum(F.col("y") * F.col("_w")).alias("_y"),
        F.array_sort(F.collect_set("route_id")).alias("routes"),
    )
    slow = F.sum(F.col("s1") + F.col("s2") + F.col("s3"))
    share = lambda c: F.when(slow > 0, F.sum(c) / slow).otherwise(0.0)
    late = F.when(F.col("delay") > 0, F.struct("mode", F.col("delay") / 3600.0 / days))
    cells = modes.groupBy("cx", "cy", "heading", "underground").agg(
        (F.sum("delay") / 3600.0 / days).alias("hours"), (F.sum("_x") / F.sum("_w")).alias("x"), (F.sum("_y") / F.sum("_w")).alias("y"),
        F.map_from_entries(F.collect_list(late)).alias("by_mode"), F.map_from_entries(F.collect_list(F.struct("mode", "routes"))).alias("routes"),
        share("s1").alias("crawl"), share("s2").alias("dwell"), share("s3").alias("stopped"),
    )
    worst = cells.where(F.col("hours") >= least_hours).orderBy(F.desc(F.round("hours", 6)), "cx", "cy", "heading", "underground").limit(top)
    return nearest_stop(worst, stops, ["cx", "cy", "heading", "underground"])


def nearest_stop(places: DataFrame, stops: DataFrame, keys: list[str], dropped: str = "Metro ", cell: float = 125.0, levels: int = 16) -> DataFrame:
    """``places`` with the ``name`` of the nearest stop, first of those of the same level, then of all; ties: the smaller id.

    Rings of cells that grow by powers of two: a place looks for the finest grid
    with a stop in its cell or the eight around it. No stop nearer than that one
    is outside the nine cells of the grid four times as wide, so only their stops
    are compared. All of it is equi-joins on cells; what is looked at depends on
    how far the nearest stop is, not on how many stops there are. ``dropped``
    leaves the name; a place underground gets " (subway)". Without stops the name is null.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    size = lambda k: F.lit(cell) * F.pow(F.lit(2.0), k)
    at = lambda x, k: F.floor(F.col(x) / size(k)).cast("long")
    grids = stops.select("stop_id", "name", "x", "y", F.col("underground").alias("_level"), F.explode(F.sequence(F.lit(0), F.lit(levels + 2))).alias("_k"))
    grids = grids.withColumns({"_cx": at("x", F.col("_k")), "_cy": at("y", F.col("_k"))})
    asked = places.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("underground").alias("_below"), F.explode(F.array(F.lit(False), F.lit(True))).alias("_level"))

    def ring(rows: DataFrame) -> DataFrame:
        cells = rows.withColumn("_o", F.explode(around))
        return cells.withColumns({"_cx": at("_x", F.col("_k")) + F.col("_o.i"), "_cy": at("_y", F.col("_k")) + F.col("_o.j")}).drop("_o")

    on = ["_level", "_k", "_cx", "_cy"]
    looked = ring(asked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(levels)))))
    finest = looked.join(grids.select(*on).distinct(), on, "left_semi").groupBy(*keys, "_x", "_y", "_below", "_level").agg(F.min("_k").alias("_k"))
    near = ring(finest.withColumn("_k", F.col("_k") + 2)).join(grids, on)
    far = F.round(F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))), 6)
    best = near.groupBy(*keys).agg(F.min_by("name", F.struct(F.col("_level") != F.col("_below"), far, "stop_id")).alias("_name"))
    tail = F.when(F.col("underground"), " (subway)").otherwise("")
    return places.join(best, keys, "left").withColumn("name", F.concat(F.replace("_name", F.lit(dropped), F.lit("")), tail)).drop("_name")


def hotspot_topk(places: DataFrame, mode: str | None = None, top: int = 40, least_hours: float = 0.05) -> DataFrame:
    """The worst of ``hotspot_places``, of one ``mode`` or all, with the cause of most of their slow seconds.

    Ties of causes go to stopped, then to crawling. With a mode, hours and routes are its own.
    """
    cause = F.when((F.col("stopped") >= F.col("dwell")) & (F.col("stopped") >= F.col("crawl")), "stopped").when(F.col("crawl") >= F.col("dwell"), "crawl").otherwise("dwell")
    own = F.array_sort(F.flatten(F.map_values("routes"))) if mode is None else F.col("routes")[mode]
    hours = F.col("hours") if mode is None else F.col("by_mode")[mode]
    rows = places.withColumns({"hours": hours, "routes": F.concat_ws(",", own), "cause": cause}).where(F.col("hours") >= least_hours)
    return rows.orderBy(F.desc(F.round("hours", 6)), "cx", "cy", "heading", "underground").limit(top).select("cx", "cy", "heading", "underground", "name", "hours", "cause", "routes")


def also_rapid(stops: DataFrame) -> DataFrame:
    """``stops`` (line, direction_id, route_id, place, rapid) with ``at_rapid``: whether a rapid route of the line, not this one, halts at the place in this direction."""
    fast = stops.where("rapid").select("line", "direction_id", "place", F.col("route_id").alias("_other")).distinct()
    by = fast.groupBy("line", "direction_id", "place").agg(F.collect_set("_other").alias("_others"))
    found = stops.join(by, ["line", "direction_id", "place"], "left")
    return found.withColumn("at_rapid", F.coalesce(F.exists("_others", lambda o: o != F.col("route_id")), F.lit(False))).drop("_others")
