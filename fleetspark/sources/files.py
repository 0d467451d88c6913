"""Readers and writers with explicit schemas: landed feeds in, tables and documents out."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PING = "vehicle_position_date_time timestamp_ntz, vehicle_id bigint, loc_x double, loc_y double, heading int, average_speed int, route_id string, direction_id int, trip_id string"
FEED = "gtfs_dataset_name string, vehicle_id string, trip_id string, trip_route_id string, trip_direction_id int, position_latitude double, position_longitude double, position_bearing double, position_speed double, location_timestamp string"
SIGNAL = "cnn string, type string, street1 string, street2 string, shape struct<coordinates: array<double>>"
GTFS = {
    "routes": "route_id string, route_type string, route_short_name string, route_long_name string, route_color string",
    "trips": "trip_id string, route_id string, service_id string, shape_id string, trip_headsign string, direction_id int",
    "stops": "stop_id string, stop_name string, stop_lon double, stop_lat double",
    "shapes": "shape_id string, shape_pt_sequence int, shape_pt_lon double, shape_pt_lat double",
    "stop_times": "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string",
}


def read_feed(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Rows of one feed of a landed dump: JSON lines, gzipped or not. Broken lines are left to ``broken_lines``."""
    rows = _feed(spark, path).where("f._broken is null").select("f.*")
    return rows.where(F.col("gtfs_dataset_name") == feed).drop("gtfs_dataset_name", "_broken")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of all lines of a dump that aren't JSON of its schema, to be kept in a quarantine table."""
    return _feed(spark, path).where("f._broken is not null").select("file", "line")


def _feed(spark: SparkSession, path: str) -> DataFrame:
    """Lines are read as text, so that a broken one is known with its file."""
    parsed = F.from_json("value", f"{FEED}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("f"), F.col("value").alias("line"), F.input_file_name().alias("file"))


def land_feed(spark: SparkSession, path: str, feed: str, table: str, quarantine: str) -> None:
    """Write the rows of one feed to ``table``, and all broken lines to ``quarantine``, which repeated runs replace."""
    read_feed(spark, path, feed).write.mode("overwrite").parquet(table)
    broken_lines(spark, path).write.mode("overwrite").parquet(quarantine)


def read_pings(spark: SparkSession, path: str) -> DataFrame:
    """Ping files of one or many days (a glob)."""
    return spark.read.schema(PING).option("header", True).option("enforceSchema", False).csv(path)


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five schedule tables; ids stay text. Columns are found by name."""
    out = {}
    for name, schema in GTFS.items():
        wanted = [c.strip().split(" ") for c in schema.split(",")]
        raw = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
        out[name] = raw.select(*[F.trim(F.col(c)).try_cast(kind).alias(c) for c, kind in wanted])
    return out


def read_signals(spark: SparkSession, path: str, types: tuple[str, ...]) -> DataFrame:
    """Signals of the given types with a place."""
    rows = spark.read.schema(SIGNAL).option("multiLine", True).json(path)
    rows = rows.where(F.col("type").isin(*types) & F.col("shape.coordinates").isNotNull())
    return rows.select("cnn", "type", "street1", "street2", F.col("shape.coordinates")[0].alias("lon"), F.col("shape.coordinates")[1].alias("lat"))


def write_by_day(rows: DataFrame, path: str) -> None:
    """One partition per day; days that are written again replace their own files only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_documents(rows: DataFrame, path: str, key: str, order: str) -> None:
    """One JSON document per key: its rows in order, without the key, in a partition of their own."""
    body = F.struct(*[c for c in rows.columns if c != key])
    documents = rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), body.alias("row"))))).alias("value"))
    documents.write.mode("overwrite").partitionBy(key).text(path)


def shared(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fleetspark-landing-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that results read, until something takes charge of them.
made: list[str] = []


def landing(spark: SparkSession) -> str:
    """A new folder name in the shared folder; ``clear_landings`` or the ``Results`` it was made under delete it."""
    made.append(f"{shared(spark)}/landing-{uuid.uuid4().hex}")
    return made[-1]


def clear_landings(spark: SparkSession) -> None:
    """Delete what has landed so far, once no result reads it any more."""
    delete(spark, made)
    made.clear()


def delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path, system = _on(spark, name)
        system.delete(path, True)


class Results:
    """Runs queries, and deletes the folders that a result was made from once the result is gone.

    That is seen when the next query starts. A frame made of a result needs the result kept.
    """

    def __init__(self):
        self.held: list[tuple[weakref.ref, list[str]]] = []

    def of(self, query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for result, paths in [x for x in self.held if x[0]() is None]:
                delete(spark, paths)
            self.held = [x for x in self.held if x[0]() is not None]
            before = len(made)
            result = query(spark, sf_dir)
            self.held.append((weakref.ref(result), made[before:]))
            del made[before:]
            return result

        return run


def _on(spark: SparkSession, name: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(name: str, sources: list[DataFrame], settings: object, build) -> DataFrame:
    """A table that several reports start from: ``build()``, written once, one partition per ``day``, and read by all of them.

    Its key is made of the files of ``sources`` (names, lengths, times of change)
    and of ``settings``: if any of these change it is built anew, and what was
    built before from the same first folder goes. Reports that are running on that must have ended.
    """
    spark = sources[0].sparkSession
    found = sorted({f for df in sources for f in df.inputFiles()})
    states = [_on(spark, f) for f in found]
    told = [(f, s.getLen(), s.getModificationTime()) for f, s in ((f, system.getFileStatus(path)) for f, (path, system) in zip(found, states, strict=True))]
    digest = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()[:24]
    family, key = f"{shared(spark)}/stages/{name}/{digest(found[:1])}", digest((name, settings, told))
    done, system = _on(spark, f"{family}/{key}/_SUCCESS")
    if not system.exists(done):
        if system.exists(done.getParent().getParent()):
            for old in system.listStatus(done.getParent().getParent()):
                system.delete(old.getPath(), True)
        build().write.mode("overwrite").partitionBy("day").parquet(f"{family}/{key}")
    return spark.read.parquet(f"{family}/{key}")
