"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.sources import files

#: Words of a text: runs of anything but a space and the five control white spaces.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to a Python worker: the setting, Spark's default for it, ours.
BATCH_BOUND, SPARKS_BOUND, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only in a local session that names none (tests, a laptop) a new local folder
    is made and set, so that a later call finds the same one; on a cluster that
    is an error, since executors wouldn't see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fleetspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables written in each open ``scratch``, outermost first; those outside of any are their results' (see ``files.Results``).
_tables: list[list[str]] = [files.made]


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder, read it back.

    A lost executor then costs a new read, not a new computation. The table goes
    at the end of the ``scratch`` around it; with ``keep``, of the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fleetspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[-2 if keep and len(_tables) > 1 else -1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete the tables that are ``written`` inside once it ends. What is used later must be written with ``keep``."""
    _tables.append([])
    try:
        yield
    finally:
        files.delete(spark, _tables.pop())


def clear(spark: SparkSession) -> None:
    """Delete the tables of all results so far, once nothing reads them any more."""
    files.clear_landings(spark)


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started.

    Texts and sets of shingles are long, so batches that go to workers are bounded
    by ``BATCH_BYTES``, where the session doesn't name a bound of its own.
    """
    if spark.conf.get(BATCH_BOUND) == SPARKS_BOUND:
        spark.conf.set(BATCH_BOUND, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    had = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in had.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, had) if x)


def lower_ascii(column):
    """A-Z to a-z; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_parts(texts: list, limit: int = 1 << 19):
    """Index ranges of ``texts`` of about ``limit`` characters (one text at least)."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
