"""Token counts of whole texts, merged rank by rank in numpy (see ``bpe``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetspark.llm.bpe import byte_bpe
from fleetspark.llm.common import ship


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE vocabulary (.json), which every
    executor must have. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows give repeated results; other columns are ignored. Rows stay where they
    are read: no shuffle, and memory is bounded by an Arrow batch, two million
    characters (or the longest text) and the table of distinct pre-tokens.
    """
    ship(docs.sparkSession)

    def count(batches):
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = pa.array(bpe.count(texts), pa.int64())
            size = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            over = pa.array([t > limit for t in tokens.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind(docs, 'doc_id')}, n_bytes long, n_tokens long, over_limit boolean")


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
