"""Cleaning of raw pings. Each takes and gives a DataFrame; thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import scalars


def drop_incomplete(rows: DataFrame, columns: tuple[str, ...] = ("position_latitude", "location_timestamp")) -> DataFrame:
    return rows.na.drop(subset=list(columns))


def bbox_time_filter(rows: DataFrame, west: float, south: float, east: float, north: float, first: int = 3 * 3600, last: int = 86_399) -> DataFrame:
    """Rows inside the box, its edges included, from second ``first`` of the day up to but not at ``last``."""
    return rows.where(F.col("x").between(west, east) & F.col("y").between(south, north) & (F.col("t") >= first) & (F.col("t") < last))


def dedupe_pings(rows: DataFrame, tie: str = "event_id") -> DataFrame:
    """The first row by ``tie`` of each vehicle and second."""
    w = Window.partitionBy("vehicle_id", "t").orderBy(tie)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def numeric_ids(rows: DataFrame, column: str = "vehicle_id") -> DataFrame:
    return rows.withColumn(column, scalars.numeric_id(F.col(column))).where(F.col(column).isNotNull())


def vehicle_class_mode(pings: DataFrame, route_modes: DataFrame) -> DataFrame:
    """``vehicle_id, vclass``: the most common mode of the routes a vehicle reported, ties to the smallest.

    Blank routes don't count, unknown ones are "other"; so are vehicles with nothing but blanks.
    """
    known = pings.where(F.trim(F.coalesce("route_id", F.lit(""))) != "").join(route_modes.select("route_id", "mode").distinct(), "route_id", "left")
    modes = known.groupBy("vehicle_id").agg(F.mode(F.coalesce("mode", F.lit("other")), True).alias("vclass"))
    return pings.select("vehicle_id").distinct().join(modes, "vehicle_id", "left").select("vehicle_id", F.coalesce("vclass", F.lit("other")).alias("vclass"))


def feed_profile(rows: DataFrame) -> DataFrame:
    """Rows and vehicles by local date."""
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("local_date")).agg(F.count("*").alias("n_rows"), F.countDistinct("vehicle_id").alias("vehicles"))
