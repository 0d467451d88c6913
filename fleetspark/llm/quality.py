"""Quality rules: plain limits, then boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.boosting import Trees, fit, sigmoid
from fleetspark.llm.common import ship
from fleetspark.llm.textstats import class_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "shout", "words_a_line", "longest_word")
#: Along these a document may only get worse.
FALLING = ("symbols", "dup_lines", "repeats", "upper", "shout")


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows used. Base limits: words, and repeated words in percent."""

    train_rows: int = 20_000
    least_words: int = 10
    repeat_percent: int = 20
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    trees: Trees
    settings: Settings


def repeated_words(words: list) -> int:
    """Words inside 5-word windows that the text has twice or more, compared whole."""
    if len(words) < 6:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    if len(pairs) == pairs.max() + 1:  # no pair comes twice, so no window does
        return 0
    fours = np.unique(pairs[:-2] * len(words) + pairs[2:], return_inverse=True)[1].astype(np.int64)
    _, window, many = np.unique(fours[:-1] * len(number) + ids[4:], return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, np.int64)
    begin = np.flatnonzero(many[window] > 1)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + 5, -1)
    return int((np.cumsum(step) > 0).sum())


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``COUNTS`` and of ``FEATURES`` for ``texts``."""
    counts = class_counts(texts)
    table = np.zeros((len(texts), len(COUNTS)), np.int64)
    x = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = text.encode("utf-8").split()  # bytes split at exactly the six blanks
        lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
        n = len(words)
        dup = len(lines) - len(set(lines))
        table[i] = n, len(text) - counts["blank"][i], counts["symbol"][i], dup, repeated_words(words)
        if n:
            x[i, :6] = np.log1p(n), table[i, 1] / n, table[i, 2] / table[i, 1], dup / len(lines), table[i, 4] / n, len(set(words)) / n
            x[i, 10], x[i, 11] = n / len(lines), max(map(len, words))
    size = np.maximum(1, table[:, 1])
    x[:, 6] = counts["upper"] / np.maximum(1, counts["letter"])
    x[:, 7], x[:, 8], x[:, 9] = counts["digit"] / size, counts["mark"] / size, counts["shout"] / size
    return table, x


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Trees from ``labels`` (doc_id, quality; 1 is good) and the texts of ``docs``.

    At most ``train_rows`` labelled ids are used, chosen by a hash of the id.
    Ids with two labels count as good only if both say so; null ids and labels
    are left out. Without usable labels every document is kept that the base
    limits keep.
    """
    ship(docs.sparkSession)
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.train_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")

    def measure(batches):
        for batch in batches:
            _, x = statistics(batch.column("text").to_pylist())
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), flat], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(measure, f"doc_id {kind}, quality int, x array<double>").collect()  # bounded by train_rows
    found.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES))
    y = np.array([r["quality"] for r in found], int)
    if len(y) == 0:
        x, y = np.zeros((1, len(FEATURES))), np.ones(1, int)
    return Model(fit(x, y, trees=60, depth=3, falling=tuple(FEATURES.index(f) for f in FALLING)), settings)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``quality_score`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or over ``repeat_percent``
    of them in repeated 5-word windows. ``kept``: neither that nor a score of
    the trees under the threshold. Null and empty texts have no words, so they
    fail. Columns of these names are replaced; all others stay.
    """
    ship(docs.sparkSession)
    s = model.settings
    new = (*COUNTS, "base_failed", "quality_score", "kept")
    old = [c for c in docs.columns if c.lower() not in new]

    def run(batches):
        for batch in batches:
            counts, x = statistics([t or "" for t in batch.column("text").to_pylist()])
            good = sigmoid(model.trees.margin(x))
            failed = (counts[:, 0] < s.least_words) | (100 * counts[:, 4] > s.repeat_percent * counts[:, 0])
            columns = [*[pa.array(c) for c in counts.T], pa.array(failed), pa.array(good), pa.array(~failed & (good >= s.threshold))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in old], *columns], [*old, *new])

    schema = docs.select(old).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("quality_score", "double").add("kept", "boolean")
    return docs.select(old).mapInArrow(run, schema)
