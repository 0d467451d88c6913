"""How the sources of a language differ in the words they use.

Terms with the same counts in the same sources are one column of the table of
counts: a distinct vector, with its multiplicity. Pairs of sources are compared
once per distinct vector, times its multiplicity, and terms are named again only
for the ranks that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import ship, written

#: Each byte of UTF-8 as it is in terms, A-Z lower-cased, or as a space if no term has it.
BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in bytes(range(256)).lower())

#: The scale of shares.
SCALE = 1_000_000_000

COUNTS = "lang string, source string, term string, n long, docs long"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _runs(keys):
    """Where runs of equal keys begin, and how long they are."""
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    return begin, np.diff(begin, append=len(keys))


def _sums(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    lang, source, text = (pa.concat_arrays([b.column(i) for b in batches]) for i in range(3))
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    split = pc.ascii_split_whitespace(pa.array([t.translate(BYTES) for t in text.to_pylist()], pa.binary()).cast(pa.string()))
    words = split.flatten().dictionary_encode()
    # what is before a text's first space or behind its last is split off as an empty string
    code, none, k = words.indices.to_numpy(), pc.index(words.dictionary, "").as_py(), max(len(words.dictionary), 1)
    keys = (pc.list_parent_indices(split).to_numpy().astype(np.int64) * k + code)[code != none]
    keys.sort()
    begin, n = _runs(keys)
    doc, code = np.divmod(keys[begin], k)
    keys = group[doc] * k + code
    order = np.argsort(keys, kind="stable")
    begin, docs = _runs(keys[order])
    n, (found, code) = np.add.reduceat(n[order], begin) if len(begin) else docs, np.divmod(keys[order][begin], k)
    all_groups = np.unique(group)
    nothing = np.zeros_like(all_groups)
    group_lang, group_source = np.divmod(np.r_[all_groups, found], max(len(source.dictionary), 1))
    terms = pa.concat_arrays([pa.repeat("", len(nothing)), words.dictionary.take(pa.array(code))])
    return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(group_lang)), source.dictionary.take(pa.array(group_source)), terms, pa.array(np.r_[nothing, n]), pa.array(np.r_[nothing, docs])], schema=COUNTS_ARROW)


def _count(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Sums over texts of ``limit`` bytes: how often a term is in a source, in how many of its texts; and a row without a term for each source."""
    held = []

    def out():
        sums = _sums(held)
        for a in range(0, len(sums), 1 << 16):
            yield sums.slice(a, 1 << 16)

    for batch in batches:
        held.append(batch)
        if sum(b.column(2).nbytes for b in held) >= limit:
            yield from out()
            held = []
    if held:
        yield from out()


def _counts(texts: DataFrame) -> DataFrame:
    """``_count`` with the texts of a source together, a large source's in parts, so that few rows a term travel on."""
    return texts.hint("rebalance", "lang", "source").mapInArrow(_count, COUNTS)


def _share(n, all_n, terms):
    """1 + floor(10^9 (n + 1) / (all_n + terms)) of columns, exactly."""
    return F.expr(f"1 + CAST(({SCALE}BD * (CAST({n} AS DECIMAL(19,0)) + 1)) div (CAST({all_n} AS DECIMAL(19,0)) + {terms}) AS BIGINT)")


def _apart(p, q):
    """SQL of floor((p - q)^2 / q): at most 10^18, so whole numbers of 64 bits hold it."""
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def _times(m, value):
    """``m`` times ``value`` as whole numbers of 64 bits, of which ``hi`` counts by ``SCALE``.

    A sum of either over the terms of a language stays within 64 bits: all
    shares of a source sum up to 10^9 + V at most, so (p - q)^2 / q sums up to
    (10^9 + V)^2, and ``lo`` is below 10^9 for each term.
    """
    return [(F.col(m) * F.expr(f"({value}) div {SCALE}")).alias("hi"), (F.col(m) * F.expr(f"({value}) % {SCALE}")).alias("lo")]


def _joined(rows: DataFrame, groups: DataFrame, on, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, on)


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, broadcast_groups: int = 100_000) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets each source of a language apart.

    Terms are runs of letters (A-Z lower-cased) and characters beyond ASCII. A
    language keeps the V terms that are in ``least_docs`` of its documents. In a
    source with N of them, a term that is there ``count`` times has the share
    p = 1 + floor(10^9 (count + 1) / (N + V)); the language's shares are made the
    same way from all its sources. Two shares are floor((p - q)^2 / q) apart.

    - part ``pair``: item is each other source of the language, q its shares;
      the value sums all kept terms; every rank.
    - part ``term``: item is each kept term of the source whose share is above
      the language's; the first ``top`` ranks.

    Ranks are by value descending, then item in order of UTF-8. Sources without
    any term count as well. Null text, language and source are empty; each row is
    a document, repeated ones too; other columns are not looked at; an empty table gives no rows.

    Terms absent from both of two sources are all the same distance apart, those
    in one of them depend on one count only. So a vector's own sources alone are
    paired, and the rest comes from numbers of terms: nothing grows with vectors
    times all pairs of sources. The table of sources is broadcast only if it has
    ``broadcast_groups`` rows at most.
    """
    ship(docs.sparkSession)
    empty = F.lit("")
    texts = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    counts = _counts(texts).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    table = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("counts"))
    table = written(table.where(f"term = '' OR docs >= {int(least_docs)}").withColumn("counts", F.sort_array("counts")))
    terms, sources = table.where("term <> ''"), table.where("term = ''").select("lang", F.explode("counts.source").alias("source"))

    named = terms.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "counts").orderBy("term"))).where(F.col("_r") <= top)
    named = named.groupBy("lang", "counts").agg(F.collect_list("term").alias("names"))
    vectors = terms.groupBy("lang", "counts").agg(F.count("*").alias("m"), F.first("n").alias("n")).join(named, ["lang", "counts"])
    vectors = written(vectors.withColumn("id", F.monotonically_increasing_id()))

    kept = vectors.groupBy("lang").agg(F.sum("m").alias("terms"), F.sum(F.col("m") * F.col("n")).alias("lang_n"))
    sums = vectors.select("lang", "m", F.inline("counts")).groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("all_n"))
    groups = sources.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["all_n", "terms", "lang_n"])
    groups = groups.withColumn("g", F.monotonically_increasing_id())
    groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, _share("0", "all_n", "terms")).otherwise(F.lit(1).cast("long"))))
    few = groups.count() <= broadcast_groups

    entries = _joined(vectors.select("id", "lang", "m", F.col("n").alias("lang_count"), F.inline("counts")), groups, ["lang", "source"], few)
    entries = written(entries.select("id", "g", "lang", "m", "p0", _share("n", "all_n", "terms").alias("p"), _share("lang_count", "lang_n", "terms").alias("q")))

    # part pair: both absent, then those in one of the two, then those in both
    one = groups.select("lang", F.col("g").alias("a"), F.col("p0").alias("a0"), "terms")
    other = groups.select("lang", F.col("g").alias("b"), F.col("p0").alias("b0"))
    absent = _joined(one, other, "lang", few).where("a <> b").select("a", "b", *_times("terms", _apart("a0", "b0")))
    by_count = entries.groupBy("lang", F.col("g").alias("a"), "p", F.col("p0").alias("a0")).agg(F.sum("m").alias("m"))
    single = _joined(by_count, other, "lang", few).where("a <> b")
    as_first = single.select("a", "b", *_times("m", f"{_apart('p', 'b0')} - {_apart('a0', 'b0')}"))
    as_second = single.select(F.col("b").alias("a"), F.col("a").alias("b"), *_times("m", f"{_apart('b0', 'p')} - {_apart('b0', 'a0')}"))
    within = entries.groupBy("id", "m").agg(F.collect_list(F.struct("g", "p", "p0")).alias("e")).where("size(e) > 1")
    within = within.select("m", "e", F.posexplode("e").alias("i", "x")).select("m", "x", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("y"))
    change = lambda x, y: f"{_apart(f'{x}.p', f'{y}.p')} - {_apart(f'{x}.p', f'{y}.p0')} - {_apart(f'{x}.p0', f'{y}.p')} + {_apart(f'{x}.p0', f'{y}.p0')}"
    within = within.select(F.col("x.g").alias("x"), F.col("y.g").alias("y"), "m", F.expr(change("x", "y")).alias("xy"), F.expr(change("y", "x")).alias("yx"))
    (xy_hi, xy_lo), (yx_hi, yx_lo) = _times("m", "xy"), _times("m", "yx")
    within = within.groupBy("x", "y").agg(F.sum(xy_hi).alias("xy_hi"), F.sum(xy_lo).alias("xy_lo"), F.sum(yx_hi).alias("yx_hi"), F.sum(yx_lo).alias("yx_lo"))
    both = within.select(F.inline(F.expr("array(struct(x AS a, y AS b, xy_hi AS hi, xy_lo AS lo), struct(y AS a, x AS b, yx_hi AS hi, yx_lo AS lo))")))
    value = F.expr(f"CAST(SUM(hi) * {SCALE}BD + SUM(lo) AS BIGINT)").alias("value")
    pairs = absent.unionByName(as_first).unionByName(as_second).unionByName(both).groupBy("a", "b").agg(value)
    names = groups.select("g", "lang", "source")
    pairs = _joined(pairs, names.withColumnRenamed("g", "a"), "a", few)
    pairs = _joined(pairs, names.select(F.col("g").alias("b"), F.col("source").alias("item")), "b", few)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    # part term: a vector's value, its first names, then the ranks of the terms themselves
    above = entries.where("p > q").select("id", "g", F.expr(_apart("p", "q")).alias("value"))
    above = above.withColumn("_r", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("_r") <= top)
    named = _joined(above.join(vectors.select("id", "names"), "id"), names, "g", few)
    named = named.select("lang", "source", F.lit("term").alias("part"), F.explode("names").alias("item"), "value")
    ranked = named.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(ranked)
