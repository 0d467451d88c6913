"""Trips of a live feed: the steps of ``operators.segmentation`` with each vehicle's open piece as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetspark.operators.segmentation import DEFAULT, FRAGMENT, Follower, FollowSettings, Ping, Track, places_of

#: Structured Streaming keeps such state in RocksDB only.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Pings; their places are kept as JSON.
WAITING = "event_id long, t int, still boolean, places string"
TRACK = "last double, seen int, missed int, live boolean, hits int, at array<int>"


class FollowProcessor(StatefulProcessor):
    """State of a vehicle's day: its open piece (pings, shapes that are followed), and pings that the watermark hasn't passed.

    A ping is taken only once the watermark is beyond it, so late rows find their
    place and the pieces are those of the finished day. A timer at the next
    waiting ping, or where the open piece ends for want of pings, calls again.
    """

    def __init__(self, settings: FollowSettings = DEFAULT):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getListState("open", WAITING)
        self.fit = handle.getValueState("fit", "fit int")
        self.tracks = handle.getMapState("tracks", "shape string", TRACK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.event_id), int(r.t), bool(r.average_speed == 0), json.dumps([_plain(p) for p in (r.places if r.places is not None else ())])) for part in rows for r in part.itertuples()]
        return self._advance(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, [], timerValues)

    def _advance(self, key, new: list[tuple], timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() / 1000
        rows = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *new], key=lambda r: (r[1], r[0]))
        ready = [r for r in rows if r[1] < passed]
        follower, out = self._load(), []
        for r in ready:
            out += follower.step(Ping(r[0], r[1], r[2], _places(r[3])))
        while follower.ends is not None and follower.ends < passed:
            piece = follower._chosen()  # noqa: SLF001
            out.append(piece)
            for ping in follower._reset():  # noqa: SLF001
                out += follower.step(ping)
        self._save(follower, rows[len(ready) :])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_times = [t for t in (follower.ends, rows[len(ready)][1] if len(rows) > len(ready) else None) if t is not None]
        if next_times:
            self.handle.registerTimer(int(min(next_times) * 1000 + 1))
        for shape, own in out:
            first = own[0][0].key
            yield pd.DataFrame([(*key, first, p.key, p.t, shape, along) for p, along in own], columns=["day", "vehicle_id", "fragment", "event_id", "t", "shape_id", "along"])

    def _load(self) -> Follower:
        follower = Follower(self.settings)
        if self.fit.exists():
            follower.fit = self.fit.get()[0]
            follower.pings = [Ping(r[0], r[1], r[2], _places(r[3])) for r in self.open.get()]
            for (shape,), (last, seen, missed, live, hits, at) in self.tracks.iterator():
                follower.tracks[shape] = Track(shape, last, seen, missed, live, hits)
                follower.taken[shape] = {k: follower.pings[k].places[shape].along for k in at}
        return follower

    def _save(self, follower: Follower, waiting: list[tuple]) -> None:
        self._put(self.waiting, waiting)
        self._put(self.open, [(p.key, p.t, p.still, json.dumps([(x, *_values(place)) for x, place in p.places.items()])) for p in follower.pings])
        for state in (self.fit, self.tracks):
            state.clear()
        if follower.tracks:
            self.fit.update((follower.fit,))
        for x, track in follower.tracks.items():
            self.tracks.updateValue((x,), (track.last, track.seen, track.missed, track.live, track.hits, list(follower.taken[x])))

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


FIELDS = ("shape", "along", "family", "direction", "rapid", "before", "upto", "near")


def _values(place) -> tuple:
    return place.along, place.family, place.direction, place.rapid, place.before, place.upto, list(place.near)


def _plain(p) -> tuple:
    """A place of a batch, whose values are numpy's."""
    return str(p["shape"]), float(p["along"]), str(p["family"]), str(p["direction"]), bool(p["rapid"]), int(p["before"]), int(p["upto"]), [float(d) for d in p["near"]]


def _places(text: str):
    return places_of([dict(zip(FIELDS, p, strict=True)) for p in json.loads(text)])


def follow_live(placed: DataFrame, settings: FollowSettings = DEFAULT, late: str = "10 minutes") -> DataFrame:
    """Stream of ``segmentation.fragments``: pieces as they end, the last one of a vehicle ``gap`` seconds after its last fit.

    ``placed``: a stream of ``segmentation.with_places`` with ``at``, the time of
    the ping (timestamp, ``t`` seconds after 1970 began). The session must keep state in RocksDB (``ROCKS``).
    """
    keyed = placed.withWatermark("at", late).groupBy("day", "vehicle_id")
    kinds = [placed.schema[c].dataType.simpleString() for c in ("day", "vehicle_id", "event_id", "t")]
    return keyed.transformWithStateInPandas(FollowProcessor(settings), FRAGMENT.format(*kinds), "append", "eventTime")
