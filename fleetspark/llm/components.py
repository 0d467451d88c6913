"""Connected components of a large edge table, by stars, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import written


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, root`` for every end of ``edges`` (a, b): the smallest id reachable from it.

    Alternates two steps until nothing changes: each node's larger neighbours
    are hung on its smallest neighbour, then each node's smaller neighbours are.
    Edges end as stars around the roots. Both steps are a grouped minimum and a
    join; a node with very many edges is no more than a skewed key of the join.
    Every round is written, so lineage stays short.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = _smallest(small)
        hung = small.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = written(hung.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
