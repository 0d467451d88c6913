"""Local plane geometry as column expressions. The origin is a parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree along a meridian, and of longitude at the equator.
METRES_LAT, METRES_LON = 110_540.0, 111_320.0
#: Origin used where a job names none.
ORIGIN = (-122.44, 37.76)


def to_xy(lon: Column, lat: Column, origin: tuple[float, float] = ORIGIN) -> tuple[Column, Column]:
    """Metres east and north of the origin."""
    east = METRES_LON * math.cos(math.radians(origin[1]))
    return (lon - F.lit(origin[0])) * F.lit(east), (lat - F.lit(origin[1])) * F.lit(METRES_LAT)


def to_lonlat(x: Column, y: Column, origin: tuple[float, float] = ORIGIN) -> tuple[Column, Column]:
    """The inverse of ``to_xy``."""
    east = METRES_LON * math.cos(math.radians(origin[1]))
    return x / F.lit(east) + F.lit(origin[0]), y / F.lit(METRES_LAT) + F.lit(origin[1])


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of a step, 0 to 360."""
    turned = F.degrees(F.atan2(dx, dy)) + F.lit(360.0)
    return turned - F.floor(turned / F.lit(360.0)) * F.lit(360.0)


def angle_between(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings, 0 to 180."""
    apart = F.abs(a - b)
    apart = apart - F.floor(apart / F.lit(360.0)) * F.lit(360.0)
    return F.least(apart, F.lit(360.0) - apart)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)
