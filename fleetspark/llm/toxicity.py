"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon is learned in Spark from labelled rows: whole words and word
beginnings that toxic documents have far more often. Trees grow on other
labelled rows than the lexicon's, and the calibration is fitted to margins of
trees that haven't seen the row, so none of them sees how well the one before
remembers its own rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.boosting import Isotonic, Trees, fit, isotonic
from fleetspark.llm.common import ship
from fleetspark.llm.textstats import class_counts

#: Insults that are in the lexicon before anything is learned.
SEED_LEXICON = frozenset("idiot moron stupid loser trash scum worthless pathetic disgusting clown dumb fool imbecile jerk freak idiota estúpido imbécil basura idiote connard débile trottel dumm abschaum".split())
#: Second-person words of four languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine euch ihr tu te toi ton vous votre tú ti tus usted ustedes vosotros".split())
#: Signs written for letters to hide a word.
DISGUISES = str.maketrans("0134578@$!|+", "oieastbasiit")
HIDDEN = re.compile(r"[^\W\d_]+[0134578@$!|+*]+[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
FEATURES = ("words", "hits", "distinct", "weight", "top", "second", "near_you", "you", "upper", "shouted", "shout", "marks", "digits", "hidden", "hidden_hits")


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows that are used, and so the lexicon.

    A term needs ``least_documents`` toxic documents and ``least_weight`` as its
    log odds; ``window`` is how near, in words, a second person counts.
    """

    train_rows: int = 16_000
    least_documents: int = 3
    least_weight: float = 2.5
    seed_weight: float = 5.0
    window: int = 4
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    lexicon: dict
    trees: Trees
    calibration: Isotonic
    settings: Settings


def words_of(text: str) -> list[str]:
    return text.lower().split()


def bare(word: str) -> str:
    """A word without the signs around it."""
    return word.strip(".,;:!?\"'()[]{}<>-_*#%&$|/")


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class Weights:
    """Lexicon weight, hidden flag and second person of words, remembered up to a bound."""

    def __init__(self, lexicon: dict, limit: int = 400_000):
        self.lexicon, self.limit, self.known, self.you = lexicon, limit, {}, set()

    def of(self, words: list[str]) -> list[float]:
        """Weights, below zero (minus one, less) where the word was found only under a disguise."""
        if len(self.known) > self.limit:
            self.known, self.you = {}, set()
        for w in set(words).difference(self.known):
            self.known[w] = self._weigh(w)
            if bare(w) in SECOND_PERSON:
                self.you.add(w)
        return [self.known[w] for w in words]

    def _weigh(self, word: str) -> float:
        plain = max((self.lexicon.get(t, 0.0) for t in terms(bare(word))), default=0.0)
        if not plain and HIDDEN.search(word):
            shown = bare(word.translate(DISGUISES).replace("*", ""))
            hidden = max((self.lexicon.get(t, 0.0) for t in terms(shown)), default=0.0)
            return -1.0 - hidden
        return plain


def near_any(places: np.ndarray, others: np.ndarray, window: int) -> int:
    """How many of ``places`` have one of ``others`` at most ``window`` away; both rise."""
    return int((np.searchsorted(others, places + window, "right") > np.searchsorted(others, places - window, "left")).sum())


def features(texts: list[str], weights: Weights, window: int) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all zeros but for rates of an empty one."""
    counts = class_counts(texts)
    size = np.array([max(1, len(t)) for t in texts], float)
    rows = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        found = np.array(weights.of(words))
        hidden = found < 0
        weight = np.where(hidden, -found - 1, found)
        hit = np.flatnonzero(weight > 0)
        n = len(words)
        you = np.array([k for k, w in enumerate(words) if w in weights.you], int)
        near = near_any(hit, you, window)
        top = np.sort(weight[hit])[::-1]
        distinct = len({words[k] for k in hit})
        rows[i, :8] = math.log1p(n), 100 * len(hit) / n, distinct, 100 * top.sum() / n, top[0] if len(top) else 0, top[1] if len(top) > 1 else 0, 100 * near / n, 100 * len(you) / n
        rows[i, 9] = 100 * sum(map(str.isupper, text.split())) / n
        rows[i, 13], rows[i, 14] = 100 * hidden.sum() / n, 100 * (hidden & (weight > 0)).sum() / n
    rows[:, 8] = counts["upper"] / np.maximum(1, counts["letter"])
    rows[:, 10], rows[:, 11], rows[:, 12] = counts["shout"] / size, counts["mark"] / size, counts["digit"] / size
    return rows


def learn_lexicon(rows: DataFrame, settings: Settings) -> dict:
    """Terms and log odds from ``rows`` (text, toxic), whose number ``train_rows`` bounds: all that pass come to the driver."""

    def explode(batches):
        for batch in batches:
            term, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {t for w in set(map(bare, words_of(text or ""))) if w for t in terms(w)}
                term += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(toxic, pa.int64())], ["term", "toxic"])

    many = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all")).first()
    toxic, clean = many["toxic"] or 0, many["all"] - (many["toxic"] or 0)
    lexicon = dict.fromkeys(SEED_LEXICON, settings.seed_weight)
    if not toxic or not clean:
        return lexicon
    counted = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(explode, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    best = counted.where(F.col("t") >= settings.least_documents).withColumn("weight", odds).where(F.col("weight") >= settings.least_weight)
    for r in best.select("term", "weight").collect():
        lexicon[r["term"]] = max(r["weight"], lexicon.get(r["term"], 0.0))
    return lexicon


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from ``labels`` (doc_id, toxic) and the texts of ``docs``.

    At most ``train_rows`` labelled ids are used, chosen by a hash of the id:
    half for the lexicon, half for the trees and, in five folds, the calibration.
    Ids with two labels count as toxic if one says so; null ids and labels are
    left out. Without usable labels the seed lexicon and a flat model remain.
    """
    ship(docs.sparkSession)
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = ids.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(settings.train_rows)
    picked = picked.withColumn("_part", F.pmod(F.hash("doc_id"), F.lit(10)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    lexicon = learn_lexicon(rows.where("_part < 5"), settings)

    def measure(batches):
        weights = Weights(lexicon)
        for batch in batches:
            x = features(batch.column("text").to_pylist(), weights, settings.window)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("_part"), flat], ["doc_id", "toxic", "_part", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    measured = rows.where("_part >= 5").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.col("_part").cast("int").alias("_part")).mapInArrow(measure, f"doc_id {kinds['doc_id']}, toxic int, _part int, x array<double>")
    found = sorted(measured.collect(), key=lambda r: r["doc_id"])  # bounded by train_rows
    x = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES))
    y, part = np.array([r["toxic"] for r in found], int), np.array([r["_part"] for r in found], int)
    rising = tuple(FEATURES.index(f) for f in ("hits", "distinct", "weight", "top", "second", "hidden_hits"))
    grown = lambda rows: fit(x[rows], y[rows], trees=50, depth=3, least=0.5, rising=rising)
    margin = np.zeros(len(y))
    for fold in range(5):  # each row's margin by trees that haven't seen it
        own = part == 5 + fold
        if own.any():
            margin[own] = grown(~own).margin(x[own])
    return Model(lexicon, grown(np.full(len(y), True)), isotonic(margin, y), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 if at the threshold or over).

    Only the text is looked at; null and empty texts are scored as texts
    without words. Columns of these names are replaced; all others stay.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def run(batches):
        weights = Weights(model.lexicon)
        for batch in batches:
            x = features([t or "" for t in batch.column("text").to_pylist()], weights, model.settings.window)
            p = model.calibration(model.trees.margin(x))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(p, pa.float64()), pa.array((p >= model.settings.threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = docs.select(kept).schema.add("score", "double").add("predicted", "integer")
    return docs.select(kept).mapInArrow(run, schema)


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id`` and the label ``name`` of rows that aren't held out."""
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col(name).cast("int").alias(name))
