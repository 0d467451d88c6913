"""Benchmark passages in training texts: found by their word n-grams, reported, and cut out.

DataFrame functions only. The distinct n-grams of the benchmark are a hash table
on every executor; every window of a text is hashed and looked up in it where
the text is read, and a hit counts only if the words themselves are equal.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import lower_ascii, written

#: Characters between words once A-Z are lower-cased, and in a text as it is.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

SPANS = "array<struct<begin: int, end: int>>"


def words(text):
    """The words of a text, A-Z lower-cased: digits, letters and all that is not ASCII. Null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN + "+"), "")


def benchmark_windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """``gram`` (its words), ``length``, ``items``: each distinct window of ``size`` words, with the items that have it.

    An item of fewer words is one window of its own length; one without words,
    or a null text, has none. Ids are text; a null id counts as the empty one.
    """
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("s"))
    grams = starts.select("item", F.slice("w", F.col("s"), size).alias("gram")).distinct()
    return grams.groupBy("gram").agg(F.collect_list("item").alias("items")).select("gram", F.size("gram").alias("length"), "items")


def _scan(rows: DataFrame, grams: DataFrame, lengths: list[int], marks: bool = True) -> DataFrame:
    """``row, doc_id, n_words, begin, end, items``: the hits of ``rows`` in ``grams``, which go to every executor.

    With ``marks``, one row more for each text, without begin, so that texts without hits stay.
    """
    first = 0 if marks else 1
    sized = rows.select("row", "doc_id", "w", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    starts = sized.select("*", F.explode(F.expr(f"sequence({first}, greatest(size(w) - n + 1, 0), 1)") if marks else F.expr("CASE WHEN size(w) >= n THEN sequence(1, size(w) - n + 1) END")).alias("s"))
    starts = starts.where((F.col("s") > 0) | (F.col("n") == lengths[0]))
    window = F.slice("w", F.greatest(F.col("s"), F.lit(1)), F.col("n"))
    keyed = starts.withColumn("h", F.when(F.col("s") > 0, F.xxhash64(window)))
    table = grams.select(F.xxhash64("gram").alias("g"), "gram", "items")
    same = (F.col("h") == F.col("g")) & (window == F.col("gram"))
    found = keyed.join(F.broadcast(table), same, "left").where((F.col("s") == 0) | F.col("g").isNotNull())
    begin = F.when(F.col("s") > 0, F.col("s"))
    return found.select("row", "doc_id", F.size("w").alias("n_words"), begin.alias("begin"), (begin + F.col("n") - 1).alias("end"), F.when(F.col("s") > 0, F.col("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, bound: int = 32 << 20, doc_id: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """What of each text is benchmark: ``doc_id, n_words, n_hit, spans, items, n_items, items_sha256, contaminated, text_hash``.

    A word is hit if it is in any occurrence of any window of ``benchmark_windows``.
    ``spans`` are the runs of hit words (from 1, both ends included), ``items`` the
    ids whose windows occur, sorted as text. One row for each row of ``docs``, in
    any order, repeated ids and rows and null ids included; a null text has no
    words; other columns are not looked at. Without benchmark windows nothing is hit.

    Windows are broadcast only if their text and ids are ``bound`` bytes at most.
    A larger benchmark is dealt by hash into parts of that size; the words of the
    texts are then written once and scanned for one part after the other. The
    corpus is never shuffled: what is, is a row for each text and the hits.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.struct("doc_id", "text_hash").alias("doc_id"), "w")
    grams = written(benchmark_windows(benchmark, size, item))
    weight = F.aggregate("gram", F.lit(0), lambda n, x: n + F.octet_length(x) + 16) + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    total, lengths = grams.agg(F.coalesce(F.sum(weight), F.lit(0)), F.sort_array(F.collect_set("length"))).first()
    parts, lengths = max(1, ceil(total / bound)), lengths or [size]
    if parts == 1:
        found = _scan(rows, grams, lengths)
    else:
        rows = written(rows)
        found = _scan(rows, grams.limit(0), lengths)
        for k in range(parts):  # one after the other: executors hold one part at a time
            found = found.unionByName(written(_scan(rows, grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k), lengths, marks=False)))
    spans = F.collect_set(F.when(F.col("begin").isNotNull(), F.struct("begin", "end")))
    by_row = found.groupBy("row").agg(F.first("doc_id").alias("d"), F.first("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.aggregate(F.array_sort("spans"), F.expr(f"cast(array() as {SPANS})"), _joined)
    by_row = by_row.select("d", "n_words", merged.alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"] + 1).cast("long")
    report = by_row.select("d.doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), "spans", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "d.text_hash")
    return report.withColumn("contaminated", F.col("n_hit") > 0)


def _joined(spans, s):
    """``spans`` with one more, which begins no earlier than any of them: part of the last if it begins in or beside it."""
    last = F.element_at(spans, -1)
    longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))))
    return F.when((F.size(spans) > 0) & (s["begin"] <= F.try_element_at(spans, F.lit(-1))["end"] + 1), longer).otherwise(F.concat(spans, F.array(s)))


def cut(text, spans):
    """``text`` without the words of ``spans`` and what stands before each of them; all else stays as it is."""
    pieces = F.regexp_extract_all(text, F.lit(f"{BETWEEN_ANY_CASE}*[^{BETWEEN_ANY_CASE[1:]}+"), F.lit(0))
    begins = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s["end"] + 1))
    sizes = F.zip_with(begins, F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.size(pieces) + 1)), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    kept = F.array_join(F.transform(sizes, lambda p: F.array_join(F.slice(pieces, p["a"], p["n"]), "")), "")
    return F.concat(kept, F.regexp_extract(text, f"{BETWEEN_ANY_CASE}*\\z", 0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", least_hit: int = 1, **settings) -> DataFrame:
    """``docs`` without what is in ``benchmark``, all columns kept.

    ``remove="spans"`` cuts the hit words out of texts with at least ``least_hit``
    of them; ``remove="documents"`` leaves those documents out. Other rows stay as
    they are, null texts and repeated rows included.
    """
    doc_id, text = settings.get("doc_id", "doc_id"), settings.get("text", "text")
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    hit = contamination(docs, benchmark, **settings).where(F.col("n_hit") >= least_hit)
    hit = hit.select(F.struct("doc_id", "text_hash").alias("_hit"), F.col("spans").alias("_spans")).dropDuplicates(["_hit"])
    own = F.struct(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"))
    if remove == "documents":
        return docs.join(hit, own.eqNullSafe(F.col("_hit")), "left_anti")
    both = docs.join(hit, own.eqNullSafe(F.col("_hit")), "left")
    return both.select(*[F.when(F.col("_hit").isNotNull(), cut(docs[c], F.col("_spans"))).otherwise(docs[c]).alias(c) if c == text else docs[c] for c in docs.columns])
