"""The schedule's network: which trips count, a shape and a stop pattern for each route and direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import geo
from fleetspark.functions.scalars import hms_seconds

KEY = ("route_id", "direction_id")


def weekday_trips(trips: DataFrame, routes: DataFrame, service: str, types: tuple[str, ...] = ("0", "3", "5"), skip: tuple[str, ...] = ()) -> DataFrame:
    """Trips of one service on routes of the given types, but those on the skip list."""
    kept = routes.where(F.col("route_type").isin(*types) & ~F.col("route_id").isin(*skip))
    return trips.where(F.col("service_id") == service).join(kept.select("route_id"), "route_id", "left_semi")


def trip_runtimes(stop_times: DataFrame) -> DataFrame:
    """First and last departure of each trip, and the seconds between."""
    rows = stop_times.groupBy("trip_id").agg(F.min_by("departure", "stop_sequence").alias("first"), F.max_by("departure", "stop_sequence").alias("last"))
    return rows.select("trip_id", hms_seconds(F.col("first")).alias("start"), (hms_seconds(F.col("last")) - hms_seconds(F.col("first"))).alias("runtime"))


def stop_routes(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """The sorted set of routes at each stop."""
    return stop_times.join(trips.select("trip_id", "route_id"), "trip_id").groupBy("stop_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))


def modal_shape(trips: DataFrame) -> DataFrame:
    """The most common shape of each route and direction; ties to the smallest."""
    counted = trips.groupBy(*KEY, "shape_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), "shape_id")
    return counted.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def modal_pattern(trips: DataFrame, stop_times: DataFrame, shapes: DataFrame) -> DataFrame:
    """The most common ordered stops among trips on the modal shape: the pattern, its trips, the smallest trip with it."""
    own = trips.join(shapes.select(*KEY, "shape_id"), [*KEY, "shape_id"]).select(*KEY, "trip_id")
    listed = stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("_s"))
    rows = own.join(listed, "trip_id").withColumn("pattern", F.concat_ws(",", F.transform("_s", lambda s: s["stop_id"].cast("string"))))
    counted = rows.groupBy(*KEY, "pattern").agg(F.count("*").alias("n"), F.min("trip_id").alias("trip_id"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), "trip_id")
    return counted.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pattern_offsets(patterns: DataFrame, stop_times: DataFrame) -> DataFrame:
    """``route_id, direction_id, stop_sequence, stop_id, offset_s``: scheduled seconds from the first departure at each stop of the modal patterns, by their smallest trip."""
    rows = patterns.select(*KEY, "trip_id").join(stop_times, "trip_id").withColumn("_s", hms_seconds(F.col("departure")))
    first = F.min("_s").over(Window.partitionBy("trip_id"))
    return rows.select(*KEY, "stop_sequence", "stop_id", (F.col("_s") - first).cast("int").alias("offset_s"))


def sched_by_hour(trips: DataFrame, stop_times: DataFrame, shapes: DataFrame) -> DataFrame:
    """By departure hour: trips on the modal shape, median scheduled seconds, most common headsign."""
    own = trips.join(shapes.select(*KEY, "shape_id"), [*KEY, "shape_id"]).join(trip_runtimes(stop_times), "trip_id")
    return own.groupBy(*KEY, F.floor(F.col("start") / 3600).cast("int").alias("hour")).agg(F.count("*").alias("trips"), F.percentile("runtime", 0.5).alias("runtime"), F.mode("headsign", True).alias("headsign"))


def densify_shape(vertices: DataFrame, step: float = 10.0, reach: int = 2) -> DataFrame:
    """Points every ``step`` metres along polylines (shape_id, seq, x, y), the end left out, with bearings.

    A bearing is that from ``reach`` points before to ``reach`` after, or to the ends.
    """
    w = Window.partitionBy("shape_id").orderBy("seq")
    rows = vertices.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 is not null")
    rows = rows.withColumn("_l", geo.distance(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")))
    rows = rows.withColumn("_c1", F.sum("_l").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_c0", F.col("_c1") - F.col("_l")).where("_l > 0")
    first, last = F.ceil(F.col("_c0") / step), F.ceil(F.col("_c1") / step) - 1
    rows = rows.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    share = (F.col("_k") * F.lit(step) - F.col("_c0")) / F.col("_l")
    points = rows.select("shape_id", F.col("_k").cast("int").alias("seq"), (F.col("_k") * F.lit(step)).alias("d"), (F.col("x") + share * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("y1") - F.col("y"))).alias("y"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = lambda c: F.coalesce(F.lag(c, reach).over(w), F.first(c).over(whole))
    on = lambda c: F.coalesce(F.lead(c, reach).over(w), F.last(c).over(whole))
    return points.withColumn("bearing", geo.bearing(on("x") - back("x"), on("y") - back("y")))


def project_stops(stops: DataFrame, segments: DataFrame) -> DataFrame:
    """Stops (route_id, direction_id, seq, x, y) on their route's polyline, in order: ``d`` and ``offset``.

    ``segments``: route_id, direction_id, k, x0, y0, x1, y1, c0 (distance at the
    segment's begin). Each stop takes the nearest point on a segment not before
    the stop's before it, of equally near ones the first. That makes one stop
    depend on the last: a fold over the route's stops, whose state is the segment
    reached. A route, some hundred stops and thousand segments, is one row.
    """
    line = segments.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "x0", "y0", "x1", "y1", "c0"))).alias("_line"))
    served = stops.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("_stops"))

    def foot(stop, s):
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        square = F.greatest(dx * dx + dy * dy, F.lit(1e-12))
        u = F.least(F.greatest(((stop["x"] - s["x0"]) * dx + (stop["y"] - s["y0"]) * dy) / square, F.lit(0.0)), F.lit(1.0))
        return F.hypot(s["x0"] + u * dx - stop["x"], s["y0"] + u * dy - stop["y"]), s["c0"] + u * F.sqrt(square)

    def place(state, stop):
        ahead = F.slice("_line", state["at"] + 1, F.size("_line"))
        feet = F.transform(ahead, lambda s, i: F.struct(foot(stop, s)[0].alias("offset"), (state["at"] + i).alias("at"), foot(stop, s)[1].alias("d")))
        best = F.array_min(feet)
        done = F.array(F.struct(stop["seq"].alias("seq"), best["d"].alias("d"), best["offset"].alias("offset")))
        return F.struct(best["at"].alias("at"), F.concat(state["done"], done).alias("done"))

    kind = stops.schema["seq"].dataType.simpleString()
    none = F.expr(f"named_struct('at', 0, 'done', cast(array() as array<struct<seq: {kind}, d: double, offset: double>>))")
    return served.join(line, list(KEY)).select(*KEY, F.inline(F.aggregate("_stops", none, place)["done"]))
