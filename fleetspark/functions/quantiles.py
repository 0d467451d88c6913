"""Quantiles of groups: exact, or from sketches that can be kept by day and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch whose ranks are off by less than 1% of the rows, nearly always.
SIZE = 400


def quantile(value: str | Column, share: float, sketch: int = 0) -> Column:
    """An aggregate: the quantile of a group, between neighbours where it falls between them.

    With ``sketch``, the size of a sketch, a value of the group near that rank
    instead: memory no longer grows with the group, as it does for exact ones.
    """
    if not sketch:
        return F.percentile(value, share)
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(column, F.lit(sketch)), F.lit(float(share)))


def daily_sketches(rows: DataFrame, keys: list[str], value: str, day: str = "day", size: int = SIZE) -> DataFrame:
    """``keys, day, n, sketch``: one small row per group and day, to be stored in the day's partition.

    Null values don't count; a group without others has no row.
    """
    held = rows.where(F.col(value).isNotNull())
    return held.groupBy(*keys, day).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], shares: dict[str, float], size: int = SIZE) -> DataFrame:
    """``keys, n`` and a column for each of ``shares``: quantiles over all days whose ``daily_sketches`` are given; no row is read again."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("_s"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(name) for name, q in shares.items()])
