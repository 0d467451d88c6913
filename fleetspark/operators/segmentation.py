"""Trips of pings that name none: follow the shapes a vehicle may be on, keep the one that it stays on.

``Follower`` takes one vehicle's pings as they come, so a finished day and a
live stream run the same steps; pieces of one shape are put together in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FollowSettings:
    """Pings, seconds, metres and shares."""

    misses: int = 4
    gap: int = 600
    backslide: float = 120.0
    speed: float = 25.0
    slack: float = 200.0
    joining: int = 6
    sibling_share: float = 0.6
    halt_reach: float = 30.0
    halts: int = 3
    halt_share: float = 0.2
    least_span: float = 30.0
    merge_gap: int = 600
    merge_back: float = 300.0


DEFAULT = FollowSettings()


@dataclass(frozen=True)
class Place:
    """Where a ping may be on a shape; how many stops that only the local route has are before and up to it, and those near it."""

    along: float
    family: str
    direction: str = ""
    rapid: bool = False
    before: int = 0
    upto: int = 0
    near: tuple[float, ...] = ()


@dataclass
class Ping:
    """``key`` names it; ``still``: it reports no speed."""

    key: int
    t: int
    still: bool
    places: dict[str, Place]


@dataclass
class Track:
    """A shape that is, or was, followed in the open piece."""

    shape: str
    last: float
    seen: int
    missed: int = 0
    live: bool = True
    hits: int = 1

    def take(self, t: int, place: Place) -> None:
        self.last, self.seen, self.missed, self.hits = max(self.last, place.along), t, 0, self.hits + 1

    def may_be(self, t: int, place: Place | None, s: FollowSettings) -> bool:
        return place is not None and place.along >= self.last - s.backslide and place.along - self.last <= s.speed * (t - self.seen) + s.slack

    @property
    def rank(self) -> tuple[int, str]:
        """Most pings first, then the smallest name."""
        return -self.hits, self.shape


@dataclass
class Follower:
    """Cuts one vehicle's pings, in order of time, into pieces, each on one shape.

    A shape is followed while the vehicle gets on along it, some misses allowed.
    Shapes join in a piece's first pings, or later if one of their family and
    direction is followed. A piece ends when nothing is followed or nothing fits
    for long; what came after its last fit is looked at again.
    """

    settings: FollowSettings = DEFAULT
    pings: list[Ping] = field(default_factory=list)  # of the open piece, and those after its last fit
    fit: int = 0
    tracks: dict[str, Track] = field(default_factory=dict)
    taken: dict[str, dict[int, float]] = field(default_factory=dict)  # by shape: number of the ping in the piece, along

    def step(self, ping: Ping) -> Iterator[tuple[str, list[tuple[Ping, float]]]]:
        """Take the next ping; give the pieces that end before it."""
        waiting = [ping]
        while waiting:
            now = waiting.pop(0)
            if not self.tracks:
                self._open(now)
            elif not self._goes_on(now):
                yield self._chosen()
                waiting = [*self._reset(), now, *waiting]

    def close(self) -> Iterator[tuple[str, list[tuple[Ping, float]]]]:
        """No ping comes for long, or none at all any more."""
        while self.tracks:
            yield self._chosen()
            for ping in self._reset():
                yield from self.step(ping)

    @property
    def ends(self) -> int | None:
        """The time from which a ping can't belong to the open piece."""
        return self.pings[self.fit].t + self.settings.gap if self.tracks else None

    def _open(self, ping: Ping) -> None:
        if ping.places:
            self.pings, self.fit = [ping], 0
            self.tracks = {x: Track(x, p.along, ping.t) for x, p in ping.places.items()}
            self.taken = {x: {0: p.along} for x, p in ping.places.items()}

    def _reset(self) -> list[Ping]:
        rest = self.pings[self.fit + 1 :]
        self.pings, self.fit, self.tracks, self.taken = [], 0, {}, {}
        return rest

    def _line(self, shape: str) -> tuple[str, str]:
        place = self.pings[next(iter(self.taken[shape]))].places[shape]
        return place.family, place.direction

    def _goes_on(self, ping: Ping) -> bool:
        s, k, t, here = self.settings, len(self.pings), ping.t, ping.places
        if t - self.pings[self.fit].t > s.gap:
            return False
        live = {x for x, track in self.tracks.items() if track.live}
        hit = {x for x in live if self.tracks[x].may_be(t, here.get(x), s)}
        missing = {x for x in live - hit if self.tracks[x].missed < s.misses}
        lines = {self._line(x) for x in hit | missing}
        new = {x for x, p in here.items() if x not in self.tracks and (k < s.joining or (p.family, p.direction) in lines)}
        if not hit | missing | new:
            return False
        for x in live - hit - missing:
            self.tracks[x].live = False
        for x in hit:
            self.tracks[x].take(t, here[x])
            self.taken[x][k] = here[x].along
        for x in missing:
            self.tracks[x].missed += 1
        for x in new:
            self.tracks[x], self.taken[x] = Track(x, here[x].along, t), {k: here[x].along}
        self.pings.append(ping)
        self.fit = k if hit | new else self.fit
        return True

    def _chosen(self) -> tuple[str, list[tuple[Ping, float]]]:
        """The followed shape with most pings, and those.

        A local route and its rapid sibling, of one family, share streets: it is
        the local one if the vehicle halted at enough of the stops that only the
        local one has. A sibling counts even if it isn't followed any more.
        """
        s = self.settings
        best = min((x for x in self.tracks.values() if x.live), key=lambda x: x.rank)
        close = sorted((x for x in self.tracks.values() if self._line(x.shape)[0] == self._line(best.shape)[0] and x.hits >= s.sibling_share * best.hits), key=lambda x: x.rank)
        rapid = lambda x: self.pings[next(iter(self.taken[x.shape]))].places[x.shape].rapid
        local, fast = (next((x for x in close if rapid(x) == kind), None) for kind in (False, True))
        if local and fast:
            own = [self.pings[k] for k in self.taken[local.shape]]
            places = [p.places[local.shape] for p in own]
            first, last = (f(places, key=lambda p: p.along) for f in (min, max))
            passed = last.upto - first.before
            halts = sum(p.still and any(first.along <= d <= last.along for d in place.near) for p, place in zip(own, places, strict=True))
            best = local if halts >= max(s.halts, s.halt_share * passed) else fast
        return best.shape, [(self.pings[k], along) for k, along in self.taken[best.shape].items()]


def pieces(pings: Iterable[Ping], s: FollowSettings = DEFAULT) -> Iterator[tuple[str, list[tuple[Ping, float]]]]:
    """Of a finished day."""
    follower = Follower(s)
    for ping in pings:
        yield from follower.step(ping)
    yield from follower.close()


PLACE = "struct<shape: string, along: double, family: string, direction: string, rapid: boolean, before: int, upto: int, near: array<double>>"
FRAGMENT = "day {}, vehicle_id {}, fragment long, event_id {}, t {}, shape_id string, along double"


def places_of(found) -> dict[str, Place]:
    """From rows or dicts of ``PLACE``."""
    return {p["shape"]: Place(p["along"], p["family"], p["direction"], p["rapid"], p["before"], p["upto"], tuple(p["near"])) for p in (found if found is not None else ())}


def with_places(pings: DataFrame, candidates: DataFrame, shapes: DataFrame, local_stops: DataFrame, s: FollowSettings = DEFAULT) -> DataFrame:
    """``day, vehicle_id, event_id, t, average_speed, places``: each ping with the shapes that it may be on.

    ``candidates``: event_id, shape_id, along. ``shapes``: shape_id, family,
    direction_id, rapid. ``local_stops``: shape_id, d, of stops that only the local route has.
    """
    stops = local_stops.groupBy("shape_id").agg(F.collect_list("d").alias("_ds"))
    ds, along = F.coalesce("_ds", F.array().cast("array<double>")), F.col("along")
    count = lambda test: F.size(F.filter(ds, test))
    found = candidates.join(shapes.select("shape_id", "family", "direction_id", "rapid"), "shape_id").join(stops, "shape_id", "left")
    place = F.struct(
        F.col("shape_id").cast("string").alias("shape"), along, F.coalesce(F.col("family").cast("string"), F.lit("")).alias("family"), F.coalesce(F.col("direction_id").cast("string"), F.lit("")).alias("direction"), F.coalesce("rapid", F.lit(False)).alias("rapid"),
        count(lambda d: d < along).alias("before"), count(lambda d: d <= along).alias("upto"), F.filter(ds, lambda d: F.abs(d - along) <= s.halt_reach).alias("near"),
    )
    listed = found.groupBy("event_id").agg(F.sort_array(F.collect_list(place)).alias("places"))
    return pings.select("day", "vehicle_id", "event_id", "t", "average_speed").join(listed, "event_id", "left")


def fragments(placed: DataFrame, s: FollowSettings = DEFAULT) -> DataFrame:
    """``day, vehicle_id, fragment, event_id, t, shape_id, along``: the pings of each piece; ``fragment`` is the first one's event.

    ``placed`` is made by ``with_places``. What is left to Python is one vehicle's
    day, some thousand pings, whose steps depend on each other.
    """
    import pandas as pd

    def follow(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["t", "event_id"])
        taken = [Ping(k, int(t), speed == 0, places_of(found)) for k, (t, speed, found) in enumerate(zip(day.t, day.average_speed, day.places, strict=True))]
        out = [(own[0][0].key, ping.key, shape, along) for shape, own in pieces(taken, s) for ping, along in own]
        if not out:
            return pd.DataFrame()
        first, at, shape, along = (list(x) for x in zip(*out, strict=True))
        return day.iloc[at][["day", "vehicle_id", "event_id", "t"]].assign(fragment=day.event_id.iloc[first].to_numpy(), shape_id=shape, along=along)

    kinds = [placed.schema[c].dataType.simpleString() for c in ("day", "vehicle_id", "event_id", "t")]
    return placed.groupBy("day", "vehicle_id").applyInPandas(follow, FRAGMENT.format(*kinds)).select("day", "vehicle_id", "fragment", "event_id", "t", "shape_id", "along")


def stitch_fragments(rows: DataFrame, s: FollowSettings = DEFAULT) -> DataFrame:
    """``rows`` of ``fragments`` in trips: all their columns but ``fragment``, and ``trip``, the time at which a trip begins.

    Pieces that span less than ``least_span`` go. A piece joins the one before it
    if both are on one shape, at most ``merge_gap`` seconds lie between, and it
    begins at most ``merge_back`` metres behind the farthest point of the trip so
    far. The first two are a window over pieces; the third is a fold over the
    few pieces of a run, since a trip that ends starts its farthest point anew.
    """
    own = ("day", "vehicle_id")
    each = rows.groupBy(*own, "fragment").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("shape_id").alias("shape_id"), F.min_by("along", F.struct("t", "event_id")).alias("a0"), F.min("along").alias("low"), F.max("along").alias("high"))
    in_time = Window.partitionBy(*own).orderBy("t0", "fragment")
    each = each.where(F.col("high") - F.col("low") >= s.least_span)
    fits = (F.col("shape_id") == F.lag("shape_id").over(in_time)) & (F.col("t0") - F.lag("t1").over(in_time) <= s.merge_gap)
    each = each.withColumn("_new", F.when(fits, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(in_time))
    runs = each.groupBy(*own, "_run").agg(F.array_sort(F.collect_list(F.struct("t0", "fragment", "a0", "high"))).alias("parts"))
    first = F.expr("cast(null as struct<trip: int, high: double, done: array<struct<fragment: bigint, trip: int>>>)")

    def joined(trip, part):
        back = trip.isNull() | (part["a0"] < trip["high"] - s.merge_back)
        begin = F.when(back, part["t0"]).otherwise(trip["trip"]).cast("int")
        high = F.when(back, part["high"]).otherwise(F.greatest(trip["high"], part["high"]))
        done = F.concat(F.coalesce(trip["done"], F.expr("cast(array() as array<struct<fragment: bigint, trip: int>>)")), F.array(F.struct(part["fragment"].cast("long").alias("fragment"), begin.alias("trip"))))
        return F.struct(begin.alias("trip"), high.alias("high"), done.alias("done"))

    trips = runs.select(*own, F.inline(F.aggregate("parts", first, joined)["done"]))
    return rows.join(trips, [*own, "fragment"]).select(*own, "event_id", "t", "shape_id", "along", F.col("trip").cast("long").alias("trip"))


def segment_unlabelled(pings: DataFrame, candidates: DataFrame, shapes: DataFrame, local_stops: DataFrame, s: FollowSettings = DEFAULT) -> DataFrame:
    """``day, vehicle_id, event_id, t, shape_id, along, trip``: pings in trips; see ``with_places``, ``fragments`` and ``stitch_fragments``."""
    return stitch_fragments(fragments(with_places(pings, candidates, shapes, local_stops, s), s), s)
