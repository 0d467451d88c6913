"""All registered queries of the fleet jobs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.jobs.checks import statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Results as they are compared: doubles to six places, halves (but for noise) away from the edge."""
    return df.select(*[F.round(F.col(c) + F.lit(1e-9), 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Register a function under its name; ``sql`` is the select that checks it, over the views in ``checks``."""

    def put(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql:
            SQL[function.__name__] = statement(sql, doubles)
        return function

    return put


def _load() -> None:
    from fleetspark.jobs import clean_queries, corridor_queries, follow_queries, grid_queries, more_queries, network_queries, ping_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(SQL)
