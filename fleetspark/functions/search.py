"""Binary search in sorted arrays, as columns: what lies where on a route, without looking at all of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _search(values: Column, goes_right) -> Column:
    """How many first elements of a sorted array ``goes_right`` holds for; it holds for none after one that it doesn't.

    Strides of falling powers of two, each taken if the element at its end is still to the left; one past the end is null, so it isn't.
    """
    bits = F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int")
    strides = F.slice(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), -F.greatest(bits, F.lit(1)), F.greatest(bits, F.lit(1)))
    return F.aggregate(strides, F.lit(0), lambda at, by: F.when(goes_right(F.get(values, at + by - 1)), at + by).otherwise(at))


def count_below(values: Column, x: Column, field: str | None = None) -> Column:
    """How many elements of a sorted array (or their ``field``) are less than ``x``: the place of the first that isn't, from 0."""
    return _search(values, lambda v: (v[field] if field else v) < x)


def count_up_to(values: Column, x: Column, field: str | None = None) -> Column:
    """How many are ``x`` or less."""
    return _search(values, lambda v: (v[field] if field else v) <= x)


def between(values: Column, low: Column, high: Column, field: str | None = None, high_too: bool = True) -> Column:
    """The elements of a sorted array from ``low`` to ``high``, ``high`` itself only if ``high_too``."""
    begin, end = count_below(values, low, field), (count_up_to if high_too else count_below)(values, high, field)
    return F.slice(values, begin + 1, F.greatest(end - begin, F.lit(0)))
