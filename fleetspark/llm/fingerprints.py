"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch is a table of cells in three parts, each cell the exclusive or of the
digests that hash to it. Two versions' sketches subtract cell by cell; what is
left are the digests that only one has, and peeling gets them back: a cell with
one digest shows it, taking it out of its other cells shows more.

A fingerprint is the number of digests and one table that grows with it. Its
places are low bits of hashes, so a table folds into any smaller one, and a
fingerprint holds the tables of all sizes. Two are compared in a small table
first; where that fails, in the largest that both have. All that a likeness
needs is in the two fingerprints: what even that table doesn't give back is
estimated from the cells that are left.

Everything is DataFrame functions: cells are rows, a sketch is a grouped
exclusive or, a sweep of peeling another one. The text is shuffled once, to
bring each document to the one after it, the digests once more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import written

#: Paragraphs are lines, cut further after sentences: a text of one line has some too.
CUT = r"\n+|(?<=[.?!])[ \t\n\x0B\f\r]+"
#: Cells of a part for each digest, and the least size of a part as a power of two; only cells in use are written.
ROOM, LEAST = 4.0, 10
#: Tries: how often the table is halved, and the sweeps over its parts.
TRIES = ((2, 6), (0, 6))
#: A digest has 48 bits, of which the low 12 check the others.
_CHECK = 0xFFF
_CLEAR = 0xFFFFFFFFF000


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of ``text``: 36 bits of hash, 12 that check them."""
    spread = F.transform(F.filter(F.split(text, CUT), lambda p: p != ""), lambda p: F.xxhash64(p).bitwiseAND(F.lit(_CLEAR)))
    return F.transform(F.array_distinct(spread), lambda h: h.bitwiseOR(_check(h)))


def _check(digest: Column) -> Column:
    """The low bits of a digest, which follow from the others."""
    return F.xxhash64(F.shiftrightunsigned(digest, 12)).bitwiseAND(F.lit(_CHECK))


def size_of(n: Column) -> Column:
    """The power of two that a part of the table of ``n`` digests has as its size."""
    return F.greatest(F.lit(LEAST), F.ceil(F.log2(F.greatest(n, F.lit(1)) * F.lit(ROOM)))).cast("int")


def cell_of(digest: Column, part: Column | int, size: Column) -> Column:
    """Where a digest is in a part: the low ``size`` bits of a hash, above the part's two."""
    part = F.lit(part) if isinstance(part, int) else part
    return _folded(F.xxhash64(digest, part), size) * 4 + part


def _folded(place: Column, size: Column) -> Column:
    return place.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1)


def sketches(sets: DataFrame) -> DataFrame:
    """``row, version, size, pairs, cell, x``: the cells that aren't empty of the sketches of ``sets`` (row, versions).

    ``versions`` are three arrays of digests; ``pairs`` holds the sizes in which
    the second and the third can be compared with the first, eight bits each.
    ``sets`` is dealt by row, and so is all that follows.
    """
    size = [size_of(F.size(F.get("versions", F.lit(k)))) for k in range(3)]
    pairs = F.least(size[0], size[1]) + 256 * F.least(size[0], size[2])
    each = sets.select("row", pairs.alias("pairs"), F.posexplode("versions").alias("version", "keys"))
    each = each.select("row", "version", size_of(F.size("keys")).alias("size"), "pairs", F.explode("keys").alias("x"))
    placed = each.select("row", "version", "size", "pairs", "x", F.explode(F.array(*[cell_of(F.col("x"), part, F.col("size")) for part in range(3)])).alias("cell"))
    return placed.groupBy("row", "version", "size", "pairs", "cell").agg(F.bit_xor("x").alias("x")).where("x <> 0")


def written_out(version: int) -> Column:
    """Aggregate: the cells of one version in order, in base 64: 16 bits of its number (32 in large tables), 48 of what it holds."""
    number = F.when(F.col("size") <= 14, F.lpad(F.hex("cell"), 4, "0")).otherwise(F.lpad(F.hex("cell"), 8, "0"))
    one = F.when(F.col("version") == version, F.struct("cell", F.concat(number, F.lpad(F.hex("x"), 12, "0")).alias("t")))
    written_ = F.base64(F.unhex(F.array_join(F.sort_array(F.collect_list(one)).getField("t"), "")))
    return F.translate(written_, "\r\n", "")


def subtracted(cells: DataFrame, halved: int) -> DataFrame:
    """``row, pair, size, cell, x, found``: versions 1 and 2 of ``cells`` against version 0, in tables of the smaller's size or, ``halved`` as
    often, smaller ones."""
    pairs = F.when(F.col("version") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("version")))
    each = cells.select("row", F.explode(pairs).alias("pair"), "pairs", "cell", "x")
    size = F.when(F.col("pair") == 1, F.col("pairs") % 256).otherwise(F.floor(F.col("pairs") / 256)).cast("int")
    each = each.select("row", "pair", F.greatest(size - halved, F.lit(LEAST)).alias("size"), "cell", "x")
    cell = _folded(F.shiftright("cell", 2), F.col("size")) * 4 + F.col("cell").bitwiseAND(F.lit(3))
    folded = each.select("row", "pair", "size", cell.alias("cell"), "x").groupBy("row", "pair", "size", "cell").agg(F.bit_xor("x").alias("x"))
    return folded.where("x <> 0").withColumn("found", F.lit(0).cast("long"))


def swept(cells: DataFrame, part: int) -> DataFrame:
    """``cells`` after all digests that are alone in a cell of ``part`` are taken out of the table.

    A digest is in one cell of a part, so none is taken out twice. Cell -1 has
    the number of those taken out so far.
    """
    x = F.col("x")
    alone = (F.col("cell").bitwiseAND(F.lit(3)) == part) & (F.col("cell") >= 0) & (x.bitwiseAND(F.lit(_CHECK)) == _check(x)) & (F.col("cell") == cell_of(x, part, F.col("size")))
    row = lambda cell, value, found: F.struct(cell.cast("long").alias("cell"), value.cast("long").alias("x"), found.cast("long").alias("found"))
    others = [row(cell_of(x, other, F.col("size")), x, F.lit(0)) for other in range(3) if other != part]
    next_ = F.when(alone, F.array(*others, row(F.lit(-1), F.lit(0), F.lit(1)))).otherwise(F.array(row(F.col("cell"), x, F.col("found"))))
    moved = cells.select("row", "pair", "size", F.explode(next_).alias("c")).select("row", "pair", "size", "c.*")
    left = moved.groupBy("row", "pair", "size", "cell").agg(F.bit_xor("x").alias("x"), F.sum("found").alias("found"))
    return left.where("x <> 0 or cell = -1")


def peeled(cells: DataFrame, sweeps: int) -> DataFrame:
    """``row, pair, size, found, rest``: digests taken out of each table, and cells that are left."""
    state = reduce(lambda c, k: swept(c, k % 3), range(sweeps), cells)
    return state.groupBy("row", "pair", "size").agg(F.sum("found").alias("found"), F.count_if(F.col("cell") >= 0).alias("rest"))


def difference(found: Column, rest: Column, size: Column, n: Column, m: Column) -> Column:
    """How many digests only one of two sketches has: those taken out, and an estimate of those left by how many cells
    they fill, as far as the numbers of digests allow."""
    cells = F.pow(F.lit(2.0), size)
    empty = F.greatest(1 - rest / (3 * cells), 1 / (6 * cells))
    left = F.when(rest == 0, 0.0).otherwise(F.greatest(F.lit(2.0), F.log(empty) / F.log(1 - 1 / cells)))
    return F.greatest(F.abs(n - m).cast("double"), F.least((n + m).cast("double"), found + left))


def likeness(n: Column, m: Column, differing: Column) -> Column:
    """Jaccard similarity of two sets of n and m digests from the size of their difference; 1 for two empty sets."""
    return F.when(n + m == 0, F.lit(1.0)).otherwise((n + m - differing) / (n + m + differing))


def compared(sets: DataFrame) -> list[DataFrame]:
    """For each of ``TRIES``, ``row`` and for versions 1 and 2 a struct (found, rest, size) of their comparison with version 0.

    ``sets`` (row, versions) is dealt by row. A later try has only pairs of which
    the ones before left cells; pairs without a difference are in none.
    """
    of = lambda pair: F.max(F.when(F.col("pair") == pair, F.struct("found", "rest", "size"))).alias(f"_d{pair}")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out: list[DataFrame] = []
    failed = None
    for halved, sweeps in TRIES:
        if failed is None:
            table = subtracted(sketches(sets), halved)
        else:
            # The row alone is the key, since everything is dealt by it; the pair is a condition.
            own = sets.join(failed.select(F.col("_row").alias("row")).hint("shuffle_hash"), "row", "left_semi")
            same = (F.col("row") == F.col("_row")) & (F.col("pair") - F.col("_pair") == 0)
            table = subtracted(sketches(own), halved).join(failed.hint("shuffle_hash"), same, "left_semi")
        tried = peeled(table, sweeps)
        if len(out) < len(TRIES) - 1:
            tried = written(tried).repartition(parts, "row")
        failed = tried.where("rest > 0").select(F.col("row").alias("_row"), F.col("pair").alias("_pair"))
        out.append(tried.groupBy("row").agg(of(1), of(2)))
    return out


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with ``_bucket``, ranges of doc_id of about equal size, by binary search in the ranges' edges."""
    edges = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else None
    edges = sorted(set(edges or ()))
    steps = len(edges).bit_length()
    found, size = F.lit(0), F.lit(len(edges))
    if edges:
        literal = F.array(*[F.lit(e).cast("long") for e in edges])
        reaches = lambda at: (at <= size) & (F.get(literal, F.least(at, size) - 1) <= F.col("doc_id"))
        found = F.aggregate(F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)]), F.lit(0), lambda at, step: F.when(reaches(at + step), at + step).otherwise(at))
    return docs.withColumn("_bucket", F.coalesce(found, F.lit(0)))


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``docs`` with ``next``, a struct of ``columns`` of the document after it, by doc_id; after the last, the first.

    ``derive`` adds columns row by row once the rows are where they stay: what it
    adds isn't shuffled, and is computed once.

    Rows with the same doc_id are ordered by their text's hash, null ids come
    first. The order is cut into ranges of ids; the first document of each range
    is also sent to the end of the range before, so no task sees them all.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_hash"]
    rows = _bucketed(docs.withColumn("_hash", F.xxhash64("text")), buckets)
    firsts = rows.groupBy("_bucket").agg(F.min(F.struct(*order)).alias("_first"))
    found = sorted(firsts.collect(), key=lambda r: r["_bucket"])  # one row per range
    kind = docs.schema["doc_id"].dataType.simpleString()
    ends = [(found[i - 1]["_bucket"], r["_first"]["doc_id"], r["_first"]["_hash"]) for i, r in enumerate(found)]
    ends = spark.createDataFrame(ends, f"_to int, _id {kind}, _h long")
    last = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))).dropDuplicates(["_to"])
    last = last.select(*docs.columns, "_hash", F.col("_to").alias("_bucket"), F.lit(1).alias("_end"))
    dealt = rows.select(*docs.columns, "_hash", "_bucket", F.lit(0).alias("_end")).unionByName(last)
    after = Window.partitionBy("_bucket").orderBy("_end", *order)
    dealt = derive(dealt.repartitionById(buckets, "_bucket"))
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(after)).where("_end = 0").drop("_hash", "_bucket", "_end")


def edited_versions(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has its last half (rounded down, in code points) replaced by
    as much of the beginning of the next document. A fingerprint is written as
    the number of digests, the size of a part (both hexadecimal) and the cells
    that aren't empty (base 64). ``near_*`` are likenesses of two fingerprints, from their
    difference. Null texts are empty; a single document is its own next one;
    repeated rows are rows of their own, side by side; doc_id must be numeric,
    null ids come first; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, ["text", "digests"], lambda found: found.withColumn("digests", digests(F.col("text"))))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next.text", F.lit(1), F.floor(n / 2).cast("int")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "digests", F.col("next.digests").alias("next"))
    versions = F.array("digests", digests(F.col("edited")), "next")
    rows = rows.select("row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), versions.alias("versions"))
    rows = written(rows.withColumn("n", F.transform("versions", lambda v: F.size(v))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    about = rows.select("row", "doc_id", "n_chars", "edited_sha256", "n").repartition(parts, "row")
    sets = rows.select("row", "versions").repartition(parts, "row")
    texts = sketches(sets).where("version < 2").groupBy("row").agg(written_out(0).alias("_f0"), written_out(1).alias("_f1"))
    out = about.join(texts, "row", "left")
    for k, tried in enumerate(compared(sets)):
        out = out.join(tried.select("row", F.col("_d1").alias(f"_d1_{k}"), F.col("_d2").alias(f"_d2_{k}")), "row", "left")
    count = [F.get("n", F.lit(k)) for k in range(3)]

    def near(pair: int) -> Column:
        own = F.coalesce(*[F.col(f"_d{pair}_{k}") for k in reversed(range(len(TRIES)))])
        lost = F.when(own.isNull(), F.lit(0.0)).otherwise(difference(own["found"], own["rest"], own["size"], count[0], count[pair]))
        return likeness(count[0], count[pair], lost)

    text = lambda k: F.concat_ws("-", F.lower(F.hex(count[k])), F.lower(F.hex(size_of(count[k]))), F.coalesce(f"_f{k}", F.lit("")))
    return out.select("doc_id", "n_chars", "edited_sha256", text(0).alias("fingerprint"), text(1).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"))
