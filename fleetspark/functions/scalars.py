"""Times, units, names and classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Miles per hour in a metre per second.
MPH = 2.23694
#: Class edges of speeds (mph) and of waits (s).
SPEED_EDGES = (6, 8, 10, 13, 16, 20)
WAIT_EDGES = (5, 10, 15, 20, 30, 45)
#: Modes by GTFS route type.
MODES = {"0": "rail", "3": "bus", "5": "cable"}
#: Classes by ranges of fleet numbers.
CLASS_RANGES = (("motor", 0, 4), ("trolley", 5, 9), ("articulated", 10, 49), ("rail", 50, 99))


def mph(metres_per_second: Column) -> Column:
    """Half-even rounded miles per hour; null is 0."""
    return F.bround(F.coalesce(metres_per_second, F.lit(0.0)) * F.lit(MPH), 0).cast("int")


def heading_degrees(degrees: Column, wrap: bool = False) -> Column:
    """Half-even rounded degrees, null is 0; ``wrap`` brings 360 to 0."""
    whole = F.bround(F.coalesce(degrees, F.lit(0.0)), 0).cast("int")
    return F.pmod(whole, F.lit(360)) if wrap else whole


def numeric_id(text: Column) -> Column:
    """A vehicle id as a number, null where it isn't one."""
    return text.try_cast("bigint")


def seconds_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def hms_seconds(text: Column) -> Column:
    """Seconds of ``HH:MM:SS``; hours may be 24 or more."""
    part = F.split(text, ":")
    return (part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")).cast("int")


def utc_to_local(text: Column, zone: str) -> Column:
    """``yyyy-MM-dd HH:mm:ss UTC`` as a local wall-clock time."""
    utc = F.to_timestamp_ntz(F.regexp_replace(text, " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def composite_time(local: Column, day: str) -> Column:
    """The local clock time on the given day."""
    clock = F.date_format(local, "HH:mm:ss")
    return F.to_timestamp_ntz(F.concat(F.lit(day + " "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))


def route_family(route_id: Column) -> Column:
    """A numeric rapid route's local sibling: ``38R`` is of the family ``38``."""
    return F.when(route_id.rlike("^[0-9]+R$"), F.regexp_replace(route_id, "R$", "")).otherwise(route_id)


def mode_of_type(route_type: Column) -> Column:
    out = F.lit("other")
    for kind, mode in MODES.items():
        out = F.when(route_type == kind, mode).otherwise(out)
    return out


def vehicle_class(vehicle_id: Column, ranges=CLASS_RANGES) -> Column:
    out = F.lit("other")
    for name, low, high in ranges:
        out = F.when(vehicle_id.between(low, high), name).otherwise(out)
    return out


def titlecase(name: Column) -> Column:
    """``04TH ST`` as ``4th St``."""
    return F.regexp_replace(F.initcap(F.lower(name)), r"\b0+(\d)", "$1")


def class_by_edges(value: Column, edges) -> Column:
    """0 below the first edge, then 1, 2 ...; null for null."""
    out = F.lit(0)
    for edge in edges:
        out = out + F.when(value >= edge, 1).otherwise(0)
    return F.when(value.isNotNull(), out).cast("int")
