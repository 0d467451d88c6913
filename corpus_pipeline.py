"""A training corpus from ``documents``: clean, deduplicate, pack.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from fleetspark.llm import jaccard_join, packing, quality, toxicity
from fleetspark.llm.common import scratch, table, written


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: str | Column) -> DataFrame:
    """The rows of ``docs`` that ``judge`` gives ``keep``, with their own columns, whatever ``judge`` calls its own."""
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    judged = judge(docs.withColumnsRenamed(own)).where(keep)
    return judged.select("doc_id", "text", *own.values()).withColumnsRenamed({new: old for old, new in own.items()}).select(docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic.

    Null and empty texts are texts without words; repeated rows are judged alike;
    an empty table gives no rows; all columns of ``docs`` stay as they are.
    """
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels"), "toxic"))
    return _kept(docs, lambda rows: toxicity.score(rows, model), "predicted = 0")


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words, so they go; otherwise as ``without_toxic``.
    """
    model = quality.train(docs, toxicity.learnable(table(spark, sf_dir, "labels"), "quality"))
    return _kept(docs, lambda rows: quality.judge(rows, model), "kept")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words are near nothing; of rows that share an id one stays,
    those without an id all do; all columns stay.
    """
    return jaccard_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents and its place in a sequence; see ``packing.best_fit_packing``."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("best_fit_packing", packed),
]

#: The models and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage writes for itself go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
