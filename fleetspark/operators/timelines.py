"""Vehicle-days: activity codes, segments, summaries and tracks for playback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import geo
from fleetspark.operators.states import stale_repeats

VEHICLE = ("day", "vehicle_id")


def activity_codes(rows: DataFrame, break_seconds: int = 45 * 60, slow_mph: int = 3) -> DataFrame:
    """``code``: the trip's state 0-3; outside trips 4 layover, 5 moving, 6 parked.

    ``rows``: day, vehicle_id, t, average_speed, trip (0 for none), state.
    """
    w = Window.partitionBy(*VEHICLE).orderBy("t")
    in_trip = F.col("trip") > 0
    mine = F.when(in_trip, F.col("t"))
    before = F.last(mine, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mine, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    slow = F.col("average_speed") < slow_mph
    out = rows.withColumn("_gap", after - before)
    return out.withColumn("code", F.when(in_trip, F.col("state")).when(slow & (F.col("_gap") < break_seconds), 4).when(slow, 6).otherwise(5).cast("int")).drop("_gap")


def timeline_segments(coded: DataFrame, gap: int = 600, last: int = 30) -> DataFrame:
    """``t0, t1, code, label``: neighbouring pings of one code and label are one segment.

    A ping with over ``gap`` seconds to the next gives its own short segment and
    one without data (7); neither joins others. The last ping lasts ``last`` seconds.
    """
    w = Window.partitionBy(*VEHICLE).orderBy("t")
    rows = coded.withColumn("_t1", F.coalesce(F.lead("t").over(w), F.col("t") + last)).withColumn("_alone", F.col("_t1") - F.col("t") > gap)
    same = (F.lag("code").over(w) == F.col("code")) & (F.lag("label").over(w) == F.col("label")) & ~F.lag("_alone").over(w) & ~F.col("_alone")
    rows = rows.withColumn("_break", F.when(same, 0).otherwise(1)).withColumn("_k", F.sum("_break").over(w))
    found = rows.groupBy(*VEHICLE, "_k").agg(F.min("t").alias("t0"), F.max("_t1").alias("t1"), F.first("code").alias("code"), F.first("label").alias("label"), F.max("_alone").alias("_alone"))
    own = F.struct(F.col("t0"), (F.col("t0") + last).alias("t1"), F.col("code"), F.col("label"))
    none = F.struct((F.col("t0") + last).alias("t0"), F.col("t1"), F.lit(7).alias("code"), F.lit("").alias("label"))
    whole = F.struct("t0", "t1", "code", "label")
    return found.select(*VEHICLE, F.explode(F.when(F.col("_alone"), F.array(own, none)).otherwise(F.array(whole))).alias("s")).select(*VEHICLE, "s.*")


def vehicle_day_summary(segments: DataFrame, in_service: DataFrame) -> DataFrame:
    """Hours in each code 0-7 and the three routes with most segments, of vehicles with a trip."""
    hours = segments.groupBy(*VEHICLE).agg(*[(F.coalesce(F.sum(F.when(F.col("code") == k, F.col("t1") - F.col("t0"))), F.lit(0)) / 3600.0).alias(f"h{k}") for k in range(8)])
    route = F.split("label", "_")[0]
    counted = segments.where("label <> ''").groupBy(*VEHICLE, route.alias("route")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*VEHICLE).orderBy(F.desc("n"), "route")
    top = counted.withColumn("_k", F.row_number().over(w)).where("_k <= 3").groupBy(*VEHICLE).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_k", "route"))), lambda s: s["route"])).alias("routes"))
    return hours.join(in_service, list(VEHICLE), "left_semi").join(top, list(VEHICLE), "left").withColumn("routes", F.coalesce("routes", F.lit("")))


def fleet_day_totals(summary: DataFrame, top: int = 250) -> DataFrame:
    """Vehicles ranked by their share of time in service that isn't moving: the top ones."""
    service = F.col("h0") + F.col("h1") + F.col("h2") + F.col("h3")
    rows = summary.withColumn("stuck", F.when(service > 0, (F.col("h1") + F.col("h2") + F.col("h3")) / service).otherwise(0.0))
    return rows.orderBy(F.desc(F.round("stuck", 9)), "vehicle_id").limit(top).select(*VEHICLE, "stuck", service.alias("service"))


def fleet_ranking(summary: DataFrame, by: str, top: int = 250) -> DataFrame:
    """Vehicles ranked by hours of ``service`` or ``layover``: the top ones."""
    rows = summary.select(*VEHICLE, (F.col("h0") + F.col("h1") + F.col("h2") + F.col("h3")).alias("service"), F.col("h4").alias("layover"))
    return rows.orderBy(F.desc(F.round(by, 6)), *VEHICLE).limit(top)


def fleet_code_hours(summary: DataFrame, codes: int = 6) -> DataFrame:
    """``code, hours, share``: vehicle-hours of the whole fleet in each of the first ``codes`` activities (not parked, not unknown)."""
    sums = summary.agg(*[F.sum(f"h{k}").alias(f"h{k}") for k in range(codes)])
    total = sum((F.col(f"h{k}") for k in range(codes)), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(k).alias("code"), F.col(f"h{k}").alias("hours"), (F.col(f"h{k}") / total).alias("share")) for k in range(codes)])
    return sums.select(F.explode(each).alias("r")).select("r.*")


def thin_positions(coded: DataFrame, least: int = 20, chunk: int = 1800) -> DataFrame:
    """Pings at least ``least`` seconds after the last one kept of their vehicle.

    Parked ones (6) go first, then stale repeats (see ``states.stale_repeats``;
    columns x, y, average_speed). What is kept depends on what was kept before,
    so a vehicle's day is a fold over its times. It goes chunk by chunk, each
    carrying on from the last time kept: a list that grows is copied with every
    time added to it, and so no list is longer than a chunk while it grows.
    """
    rows = stale_repeats(coded.where("code <> 6"))
    times = rows.groupBy(*VEHICLE, F.floor(F.col("t") / chunk).alias("_chunk")).agg(F.sort_array(F.collect_set("t")).alias("_times"))
    days = times.groupBy(*VEHICLE).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_times"))).alias("_chunks"))
    kind = rows.schema["t"].dataType.simpleString()
    none = F.expr(f"named_struct('last', cast(null as {kind}), 'kept', cast(array() as array<{kind}>))")

    def take(s, t):
        far = s["last"].isNull() | (t - s["last"] >= least)
        return F.struct(F.when(far, t).otherwise(s["last"]).alias("last"), F.when(far, F.concat(s["kept"], F.array(t))).otherwise(s["kept"]).alias("kept"))

    def carry_on(s, part):
        begin = F.struct(s["last"].alias("last"), F.expr(f"cast(array() as array<{kind}>)").alias("kept"))
        done = F.aggregate(part["_times"], begin, take)
        return F.struct(done["last"].alias("last"), F.concat(s["kept"], done["kept"]).alias("kept"))

    kept = days.select(*VEHICLE, F.explode(F.aggregate("_chunks", none, carry_on)["kept"]).alias("t"))
    return rows.join(kept, [*VEHICLE, "t"], "left_semi")


def playback_positions(rows: DataFrame, least: int = 20) -> DataFrame:
    """Thinned positions for playback, with ``label`` and ``along`` of the shape they follow, ``mph`` and ``mode``.

    ``rows``: day, vehicle_id, t, x, y, code, average_speed, trip (0 for none),
    label and along of the trip, route_key and route_along of the route that is
    reported (null off it), vclass. Outside a trip a vehicle follows the route it
    reports, if it is on it; else its label is empty and along -1. Vehicles of
    class ``other``, and those without any trip, are left out.
    """
    used = rows.groupBy(*VEHICLE).agg(F.max("trip").alias("_trips"), F.first("vclass").alias("_class")).where("_trips > 0 AND _class <> 'other'")
    on_trip, filled = F.col("along").isNotNull(), F.col("route_along").isNotNull()
    shown = rows.join(used.select(*VEHICLE), list(VEHICLE), "left_semi").withColumns({
        "label": F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).when(~on_trip & filled, F.col("route_key")).otherwise(""),
        "along": F.bround(F.coalesce("along", "route_along", F.lit(-1.0)), 0).cast("int"),
    })
    return thin_positions(shown, least).withColumn("mph", F.col("average_speed").cast("int")).withColumnRenamed("vclass", "mode")


def tile_documents(tiles: DataFrame, more: tuple[str, ...] = (), origin: tuple[float, float] = geo.ORIGIN) -> DataFrame:
    """``hour, vehicle_id, day, mode, rows``: what is in each tile, by vehicle, in time order, in small numbers.

    Places are hundred thousandths of a degree, a label is its number among the
    sorted labels of all tiles (0 for none), ``along`` whole metres (-1 for none),
    then ``mph``. ``tiles``: ``hourly_tiles`` of ``playback_positions``, and ``more``. There are some hundred
    labels, one for each route and direction, so one task numbers them.
    """
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"), origin)
    labels = tiles.where("label <> ''").select("label").distinct()
    numbered = labels.withColumn("label_no", F.row_number().over(Window.orderBy("label")))
    rows = tiles.join(numbered, "label", "left").withColumns({"label_no": F.coalesce("label_no", F.lit(0)), "lon5": F.bround(lon * 100_000, 0).cast("long"), "lat5": F.bround(lat * 100_000, 0).cast("long")})
    listed = F.array_sort(F.collect_list(F.struct("t", "lat5", "lon5", "code", "label_no", "along", "mph", *more)))
    return rows.groupBy("hour", *VEHICLE, "mode").agg(listed.alias("rows"))


def hourly_tiles(positions: DataFrame, pad: int = 1200, last_hour: int = 24) -> DataFrame:
    """Pings in every hour, up to ``last_hour``, that they are in or ``pad`` seconds from."""
    first, last = F.floor((F.col("t") - pad) / 3600).cast("int"), F.floor((F.col("t") + pad) / 3600).cast("int")
    return positions.withColumn("hour", F.explode(F.sequence(first, last))).where(F.col("hour").between(0, last_hour))


def fleet_at_times(rows: DataFrame, points: DataFrame, every: int = 300, bridge: int = 1200, straight: int = 180, back: float = 30.0, fastest: float = 35.0, step: float = 10.0) -> DataFrame:
    """``at_t, x, y, along, label, bridged``: where each vehicle is at every multiple of ``every`` seconds.

    ``rows``: day, vehicle_id, t, x, y, label (the route and direction, null
    outside trips), along (null off the route). ``points``: label, seq, x, y,
    every ``step`` metres. Between two pings on one route, no more than
    ``bridge`` seconds apart, it goes along the route; else straight on if the
    gap is at most ``straight``; over ``fastest`` metres a second it stays at the
    nearer ping. Otherwise, and after the last ping, it has no row.

    Each ping makes the grid times until the next one, so nothing is joined by time.
    """
    w = Window.partitionBy(*VEHICLE).orderBy("t")
    fix = F.struct("t", "x", "y", "label", "along")
    on = F.when(F.col("label").isNotNull() & (F.col("along") >= 0), F.struct("t", "label", "along"))
    out = rows.select(*VEHICLE, fix.alias("_a"), F.lead(fix).over(w).alias("_b"), F.last(on, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_p"), F.first(on, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_q"))
    first, last = (F.ceil(F.col("_a.t") / every) * every).cast("int"), (F.col("_b.t") - 1).cast("int")
    out = out.where(first <= last).withColumn("at_t", F.explode(F.sequence(first, last, F.lit(every))))
    carried = (F.col("_p.label") == F.col("_q.label")) & (F.col("_q.along") >= F.col("_p.along") - back) & (F.col("_q.t") - F.col("_p.t") <= bridge)
    out = out.withColumn("bridged", F.coalesce(carried, F.lit(False)))
    gap = F.col("_b.t") - F.col("_a.t")
    out = out.where(F.col("bridged") | (gap <= straight))
    share = (F.col("at_t") - F.col("_a.t")) / gap
    far = F.hypot(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")) / gap > fastest
    share = F.when(far & (share < 0.5), 0.0).when(far, 1.0).otherwise(share)
    along_trip = F.col("_p.along") + (F.col("at_t") - F.col("_p.t")) / (F.col("_q.t") - F.col("_p.t")) * (F.col("_q.along") - F.col("_p.along"))
    between = lambda c: F.col(f"_a.{c}") + share * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))
    label = F.when(F.col("bridged"), F.col("_p.label")).otherwise(F.when(share < 1, F.col("_a.label")).otherwise(F.col("_b.label")))
    along = F.when(F.col("bridged"), along_trip).otherwise(F.col("_a.along"))
    out = out.select(*VEHICLE, "at_t", between("x").alias("_x"), between("y").alias("_y"), along.alias("along"), label.alias("label"), "bridged")
    of = Window.partitionBy("label").orderBy("seq")
    shape = points.select("label", "seq", F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.coalesce(F.lead("x").over(of), "x").alias("_x1"), F.coalesce(F.lead("y").over(of), "y").alias("_y1"), F.max("seq").over(Window.partitionBy("label")).alias("_end"))
    ends = shape.select("label", F.col("_end").alias("_last")).distinct()
    seq = F.least(F.greatest(F.floor(F.col("along") / step), F.lit(0)), F.col("_last")).cast("int")
    out = out.join(ends, "label", "left").withColumn("seq", F.when(F.col("bridged"), seq)).join(shape.drop("_end"), ["label", "seq"], "left")
    part = F.least(F.greatest(F.col("along") / step - F.col("seq"), F.lit(0.0)), F.lit(1.0))
    place = lambda c: F.when(F.col("bridged"), F.col(f"_{c}0") + part * (F.col(f"_{c}1") - F.col(f"_{c}0"))).otherwise(F.col(f"_{c}"))
    return out.select(*VEHICLE, "at_t", place("x").alias("x"), place("y").alias("y"), "along", "label", "bridged")
