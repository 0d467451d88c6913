"""Map matching: candidates, trips from labelled pings, and what holds of the trips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import geo


@dataclass(frozen=True)
class MatchSettings:
    """Metres, degrees and counts. ``crowded``: pings in a cell from which on it is split; 0 for no pass that counts them."""

    radius: float = 30.0
    turn: float = 55.0
    backslide: float = 120.0
    terminal: float = 30.0
    long_enough: float = 1500.0
    share: float = 0.5
    least_share: float = 0.3
    least_pings: int = 6
    crowded: int = 50_000


DEFAULT = MatchSettings()
SHAPE = ("shape_id",)


def _cells(x, y, size: float):
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def split_crowded(left: DataFrame, right: DataFrame, on: list[str], crowded: int, part: str = "_part") -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``on`` with one more key, ``part``, that deals the rows of a crowded key of ``left`` to several tasks.

    A first pass counts ``left`` by key (with partial sums). A key with more than
    ``crowded`` rows gets a part for each ``crowded`` of them; its rows go to
    parts by their hash, those of ``right`` to all of its parts. Other keys have
    one part. The join's rows stay the same.
    """
    heavy = left.groupBy(*on).agg(F.ceil(F.count("*") / crowded).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(heavy, on, "left").withColumn(part, F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    copied = right.join(heavy, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt, copied


def near_points(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = (), crowded: int = 0) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` nearer than ``radius`` (columns x, y; ``px, py`` for the right side's).

    An equi-join on square cells as wide as the radius: the right side, the
    smaller, is sent to its cell and the eight around it. ``keys`` join too.
    With ``crowded``, cells with more rows of ``left`` than that are split (see
    ``split_crowded``), such as a depot where a whole fleet stands idle; it costs
    a pass that counts. Exact: the distance is checked.
    """
    cx, cy = _cells(F.col("x"), F.col("y"), radius)
    here = left.withColumns({"_cx": cx, "_cy": cy})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    px, py = _cells(F.col("px"), F.col("py"), radius)
    there = right.withColumn("_o", F.explode(around)).withColumns({"_cx": px + F.col("_o.i"), "_cy": py + F.col("_o.j")}).drop("_o")
    on = ["_cx", "_cy", *keys]
    if crowded:
        here, there = split_crowded(here, there, on, crowded)
        on.append("_part")
    pairs = here.join(there, on)
    return pairs.withColumn("off", geo.distance(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("off") < radius).drop("_cx", "_cy", "_part")


def match_candidates(pings: DataFrame, shapes: DataFrame, s: MatchSettings = DEFAULT, labelled: bool = False) -> DataFrame:
    """``event_id, shape_id, along, off``: for each ping the nearest point of each shape that it may be on.

    Near enough, heading the same way (or standing without a heading), same
    mode; with ``labelled`` also the reported route, and direction if known.
    Ties go to the smaller distance along.
    """
    points = shapes.select(F.col("x").alias("px"), F.col("y").alias("py"), "d", "bearing", "shape_id", "mode", F.col("route_id").alias("shape_route"), F.col("direction_id").alias("shape_direction"))
    keys = ("mode",)
    if labelled:
        points, keys = points.withColumnRenamed("shape_route", "route_id"), ("mode", "route_id")
    found = near_points(pings, points, s.radius, keys, s.crowded)
    standing = (F.col("average_speed") == 0) & (F.col("heading") == 0)
    found = found.where((geo.angle_between(F.col("heading"), F.col("bearing")) <= s.turn) | standing)
    if labelled:
        found = found.where(F.col("direction_id").isNull() | (F.col("direction_id") < 0) | (F.col("direction_id") == F.col("shape_direction")))
    best = found.groupBy("event_id", "shape_id").agg(F.min(F.struct("off", F.col("d").alias("along"))).alias("b"))
    return best.select("event_id", "shape_id", F.col("b.along").alias("along"), F.col("b.off").alias("off"))


def segment_labelled(pings: DataFrame, candidates: DataFrame, route_dir: DataFrame, s: MatchSettings = DEFAULT) -> DataFrame:
    """Pings on their reported trip's shape, with ``along`` from the candidates.

    Segments are (day, vehicle, trip, route, direction) of two pings or more;
    pings that fall behind the furthest by over ``backslide`` are dropped.
    """
    own = pings.drop("along").join(route_dir.select("route_id", "direction_id", "shape_id"), ["route_id", "direction_id"]).join(candidates, ["event_id", "shape_id"])
    key = ["day", "vehicle_id", "trip", "route_id", "direction_id"]
    order = Window.partitionBy(*key).orderBy("t")
    rows = own.withColumns({"_n": F.count("*").over(Window.partitionBy(*key)), "_far": F.max("along").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("_n") >= 2) & (F.col("along") >= F.col("_far") - s.backslide)).drop("_n", "_far", "off")


def trim_layover(pings: DataFrame, s: MatchSettings = DEFAULT) -> DataFrame:
    """Trips without the wait before they leave and after they arrive; ``along`` is made to rise.

    From the last ping within ``terminal`` of the first to the first within
    ``terminal`` of the last; nothing if that is empty or one ping.
    """
    trip = Window.partitionBy("day", "trip")
    order = trip.orderBy("t")
    rows = pings.withColumn("along", F.max("along").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_a": F.min("along").over(trip), "_z": F.max("along").over(trip), "_k": F.row_number().over(order)})
    rows = rows.withColumns({
        "_dep": F.max(F.when(F.col("along") <= F.col("_a") + s.terminal, F.col("_k"))).over(trip),
        "_arr": F.min(F.when(F.col("along") >= F.col("_z") - s.terminal, F.col("_k"))).over(trip),
    })
    return rows.where((F.col("_arr") > F.col("_dep")) & F.col("_k").between(F.col("_dep"), F.col("_arr"))).drop("_a", "_z", "_k", "_dep", "_arr")


def accept_trips(pings: DataFrame, route_dir: DataFrame, s: MatchSettings = DEFAULT) -> DataFrame:
    """Pings of trips that cover enough of their route with enough pings."""
    trip = Window.partitionBy("day", "trip")
    rows = pings.join(route_dir.select("route_id", "direction_id", "length"), ["route_id", "direction_id"])
    rows = rows.withColumns({"_span": F.max("along").over(trip) - F.min("along").over(trip), "_n": F.count("*").over(trip)})
    enough = F.greatest(F.least(F.lit(s.long_enough), F.col("length") * s.share), F.col("length") * s.least_share)
    return rows.where((F.col("_span") >= enough) & (F.col("_n") >= s.least_pings)).drop("_span", "_n", "length")


def lead_vehicle(pings: DataFrame) -> DataFrame:
    """Pings with ``lead``: of the trips that share a schedule trip, the one with the most pings leads.

    Ties go to the smaller trip. A trip's schedule trip is its most common one
    (ties: the smallest); trips without one lead.
    """
    label = F.when(F.trim("gtfs_trip_id") != "", F.col("gtfs_trip_id"))
    trips = pings.groupBy("day", "trip").agg(F.mode(label, True).alias("_g"), F.count("*").alias("_n"))
    w = Window.partitionBy("day", "_g").orderBy(F.desc("_n"), "trip")
    flags = trips.withColumn("lead", F.col("_g").isNull() | (F.row_number().over(w) == 1)).select("day", "trip", "lead")
    return pings.join(flags, ["day", "trip"])


def vehicle_pings(pings: DataFrame, matched: DataFrame, candidates: DataFrame, route_dir: DataFrame) -> DataFrame:
    """All pings with their trip (0 for none) and the distance along the reported route, also outside a trip."""
    own = matched.select("day", "vehicle_id", "t", F.col("trip").alias("in_trip"))
    shape = route_dir.select("route_id", "direction_id", "shape_id")
    rows = pings.join(own, ["day", "vehicle_id", "t"], "left").join(shape, ["route_id", "direction_id"], "left")
    rows = rows.join(candidates.select("event_id", "shape_id", F.col("along").alias("route_along")), ["event_id", "shape_id"], "left")
    return rows.select("day", "vehicle_id", "event_id", "t", "x", "y", "average_speed", F.coalesce("in_trip", F.lit(0)).cast("long").alias("trip"), F.concat_ws("_", "route_id", "direction_id").alias("route_key"), "route_along")


def match_rate(vehicle_rows: DataFrame) -> DataFrame:
    """Pings, matched pings, trips and vehicles by route."""
    return vehicle_rows.groupBy("route_key").agg(F.count("*").alias("pings"), F.count_if(F.col("trip") > 0).alias("matched"), F.countDistinct(F.when(F.col("trip") > 0, F.col("trip"))).alias("trips"), F.countDistinct("vehicle_id").alias("vehicles"))


def match_totals(vehicle_rows: DataFrame) -> DataFrame:
    """``kind, name, n``: trips by mode, and vehicles with a trip by class. ``vehicle_rows``: day, vehicle_id, trip, mode, vclass."""
    rows = vehicle_rows.where("trip > 0")
    modes = rows.groupBy(F.lit("mode").alias("kind"), F.col("mode").alias("name")).agg(F.countDistinct("day", "trip").alias("n"))
    classes = rows.groupBy(F.lit("class").alias("kind"), F.col("vclass").alias("name")).agg(F.countDistinct("vehicle_id").alias("n"))
    return modes.unionByName(classes)


def local_only_stops(stops: DataFrame, rapid: DataFrame, radius: float = 60.0) -> DataFrame:
    """Stops of local routes farther than ``radius`` from every stop of the rapid route of their family and direction.

    Both: family, direction_id, stop_id, x, y.
    """
    other = rapid.select("family", "direction_id", F.col("x").alias("px"), F.col("y").alias("py"))
    # "Not farther" includes the radius itself, so the join reaches a little beyond it.
    close = near_points(stops, other, radius * (1 + 1e-9), ("family", "direction_id"))
    return stops.join(close.select("family", "direction_id", "stop_id").distinct(), ["family", "direction_id", "stop_id"], "left_anti")
