"""The live feed as a stream: decoded vehicle positions to files by local date."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from fleetspark.functions import scalars
from fleetspark.streaming.follow import ROCKS

ENTITY = "id string, lon double, lat double, bearing double, speed double, ts long, header_ts long, route_id string, direction_id int, trip_id string"


def live_normalise(entities: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """Positions with a numeric id and coordinates; times, units and coordinates as the ping tables have them."""
    when = F.when(F.coalesce("ts", F.lit(0)) > 0, F.col("ts")).otherwise(F.col("header_ts"))
    rows = entities.withColumns({"vehicle_id": scalars.numeric_id(F.col("id")), "ts": F.timestamp_seconds(when)})
    rows = rows.where("vehicle_id is not null and lon is not null and lat is not null")
    return rows.select(
        "vehicle_id", "ts", F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd").alias("day"), F.bround("lon", 6).alias("loc_x"), F.bround("lat", 6).alias("loc_y"),
        scalars.heading_degrees(F.col("bearing"), True).alias("heading"), scalars.mph(F.col("speed")).alias("average_speed"), "route_id", F.coalesce("direction_id", F.lit(-1)).alias("direction_id"), "trip_id",
    )


def live_dedupe(positions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per vehicle and time, as long as the watermark remembers it.

    A row more than ``late`` behind the newest one of the batches but the last is
    dropped, since it can't be known to be new; ``dropped_late`` of ``Progress`` counts those.
    """
    return positions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["vehicle_id", "ts"])


#: Groups of vehicles, whose state is one value each. A stream that goes on from its checkpoint needs the same number.
GROUPS = 512
#: No time: the vehicle isn't known, or its position has none.
NEVER = -(2**63)


class ChangedProcessor(StatefulProcessor):
    """State of a group of vehicles: id, time of the last position and of the last poll of each, as packed numbers in the order of ids.

    A group's rows of a batch are worked on together, since a call for each vehicle
    takes milliseconds. A vehicle that isn't polled any more is unknown from the
    batch on whose watermark has passed its time; a timer at the next such time
    also calls for groups without rows.
    """

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fleet = handle.getValueState("fleet", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        rows = rows.iloc[np.lexsort((rows["seq"], rows["vehicle_id"]))]
        vehicle, at, polled = (rows[c].to_numpy("int64") for c in ("vehicle_id", "at", "polled_ms"))
        starts = np.flatnonzero(np.r_[True, vehicle[1:] != vehicle[:-1]])
        ids, newest, last = vehicle[starts], np.maximum.reduceat(polled, starts), at[np.r_[starts[1:], len(at)] - 1]
        watermark = timerValues.getCurrentWatermarkInMs()
        known = self._known(watermark)
        _, here, there = np.intersect1d(ids, known[0], assume_unique=True, return_indices=True)
        before = np.r_[NEVER, at[:-1]]
        before[starts] = NEVER
        before[starts[here]] = known[1, there]
        keep = (before == NEVER) | ((at != NEVER) & (at != before))
        newest[here] = np.maximum(newest[here], known[2, there])
        fleet = np.concatenate([np.delete(known, there, axis=1), [ids, last, newest]], axis=1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._keep(fleet[:, np.argsort(fleet[0])], watermark)
        out = rows.loc[keep, ["vehicle_id", "at", "seq"]].astype({"vehicle_id": "Int64", "at": "Int64"})
        out.loc[out["at"] == NEVER, "at"] = pd.NA
        yield out if key[0] >= 0 else out.assign(vehicle_id=pd.array([pd.NA] * len(out), "Int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._keep(self._known(watermark), watermark)
        yield pd.DataFrame({"vehicle_id": [], "at": [], "seq": []}, dtype="int64")

    def _known(self, watermark: int) -> np.ndarray:
        """Ids, times of positions and of polls of the vehicles that aren't due to be forgotten."""
        packed = self.fleet.get()[0] if self.fleet.exists() else b""
        return self._not_due(np.frombuffer(packed, "<i8").reshape(3, -1), watermark)

    def _keep(self, fleet: np.ndarray, watermark: int) -> None:
        fleet = self._not_due(fleet, watermark)
        if fleet.size:
            self.fleet.update((fleet.astype("<i8").tobytes(),))
            self.handle.registerTimer(int(fleet[2].min()) + self.forget_ms)
        else:
            self.fleet.clear()

    def _not_due(self, fleet: np.ndarray, watermark: int) -> np.ndarray:
        return fleet[:, fleet[2] + self.forget_ms > watermark]

    def close(self) -> None:
        pass


def live_changed_only(positions: DataFrame, forget_seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """A position only where its time differs from the vehicle's last one seen: A, B, A keeps all three.

    ``positions``: vehicle_id, at, seq, and ``polled``, the timestamp of the poll,
    by which state lives: a vehicle not polled for ``forget_seconds`` is
    forgotten once the watermark, ``late`` behind the newest poll, has passed
    that. Three numbers per vehicle, in RocksDB (``ROCKS``), so the fleets of years don't pile up. Rows of a batch are taken in the order of ``seq``.
    """
    group = F.when(F.col("vehicle_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("vehicle_id"), F.lit(GROUPS)).cast("int")).alias("group")
    number = lambda c, none: F.coalesce(c, F.lit(none).cast("long"))  # noqa: E731  # a column with nulls would reach pandas as floats
    rows = positions.select(group, number(F.col("vehicle_id"), 0).alias("vehicle_id"), number(F.col("at"), NEVER).alias("at"), "seq", "polled", number(F.unix_millis("polled"), 0).alias("polled_ms"))
    return rows.withWatermark("polled", late).groupBy("group").transformWithStateInPandas(ChangedProcessor(1000 * forget_seconds), "vehicle_id long, at long, seq long", "append", "eventTime")


def changed_only_batch(positions: DataFrame) -> DataFrame:
    """The same over a finished table (vehicle_id, at, seq), in which no vehicle is ever forgotten."""
    from pyspark.sql import Window

    last = F.lag("at").over(Window.partitionBy("vehicle_id").orderBy("seq"))
    return positions.withColumn("_last", last).where("_last is null or _last <> at").drop("_last")


def write_by_day(positions: DataFrame, path: str, checkpoint: str):
    """Append to one folder per local date; late rows go to their own day."""
    return positions.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def live_status(positions: DataFrame, path: str, checkpoint: str):
    """A row per poll (micro-batch): batch, rows, vehicles, errors (rows without vehicle or time) and the last time seen.

    A poll that is run again after a failure replaces its own row.
    """

    def tell(batch: DataFrame, number: int) -> None:
        bad = F.col("vehicle_id").isNull() | F.col("ts").isNull()
        found = batch.agg(F.count("*").alias("rows"), F.countDistinct("vehicle_id").alias("vehicles"), F.count_if(bad).alias("errors"), F.max("ts").alias("last"))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return positions.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_so_far(polls: DataFrame) -> DataFrame:
    """Running status after each poll: polls, rows and errors so far, the last time seen, the poll's own rows and vehicles."""
    from pyspark.sql import Window

    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row per poll, some thousand a day
    return polls.select("batch", F.count("*").over(w).alias("polls"), F.sum("rows").over(w).alias("rows"), F.sum("errors").over(w).alias("errors"), F.max("last").over(w).alias("last"), F.col("rows").alias("last_rows"), F.col("vehicles").alias("last_vehicles"))


class Progress(StreamingQueryListener):
    """What Spark itself tells of each batch of one query: its number, rows in, rows that state dropped as late, the watermark."""

    def __init__(self):
        self.query, self.batches, self.ended = None, {}, False

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = json.loads(event.progress.json)
        if self.query in (None, p["id"]) and (p["numInputRows"] or p["batchId"] not in self.batches):
            late = sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", ()))
            self.batches[p["batchId"]] = (p["batchId"], p["numInputRows"], late, p.get("eventTime", {}).get("watermark"))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended = True

    def table(self, spark) -> DataFrame:
        """One row per batch of a stream, which are few."""
        return spark.createDataFrame(sorted(self.batches.values()), "batch long, rows long, dropped_late long, watermark string")


def finished(stream: DataFrame, path: str, progress: Progress | None = None) -> DataFrame:
    """All that ``stream`` gives for what its source has now, as files in ``path``, read back."""
    import time

    spark = stream.sparkSession
    spark.conf.set(*ROCKS)
    if progress:
        spark.streams.addListener(progress)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        if progress:
            progress.query = str(query.id)
        query.awaitTermination()
        until = time.time() + 20
        while progress and not progress.ended and time.time() < until:  # events come by another thread
            time.sleep(0.05)
    finally:
        if progress:
            spark.streams.removeListener(progress)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
