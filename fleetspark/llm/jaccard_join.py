"""N-gram Jaccard join: count vectors in R-trees, bounds by summed minima, exact verification.

Each document's shingles are hashed into groups, and the groups' counts are its
point. The overlap of two documents is at most the sum of the smaller of their
counts over all groups; for two nodes of a tree the same holds of their boxes'
upper corners. All links are found by descending R-trees of such points; what
they let through is bounded once more by finer counts, then compared whole.

Points are dealt to trees by shingles: under one order of all shingles, two
documents that are similar enough share one of the first few of each (a fifth
of the set and one more), so a tree holds what has one shingle among its first
few. The order puts shingles last that a sample finds in many documents. It
decides nothing but the cost: under any order no pair is missed.

Equal sets are joined to one representative first. Then the trees are descended
twice. First each point looks for its few nearest ones, so that a large group of
copies becomes one piece by few pairs. Then the trees give all pairs that may
link what is still apart, without a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import scratch, ship, written
from fleetspark.llm.components import components
from fleetspark.llm.shingles import mixed, shingle_sets


@dataclass(frozen=True)
class Settings:
    """Similarity as a fraction ``part/whole``; words of a shingle; cost parameters.

    One document in ``sample`` is looked at for shingles in ``frequent`` sampled
    sets or more; at most ``frequent_limit`` of them go last. The ``nearest``
    points are tried first, sought in parts of ``near_part`` points and the
    least changed point of all parts. ``leaf`` and ``fan`` are the children of a
    tree's lowest and other nodes. When all pairs are sought, blocks of over
    ``block`` points are cut and their parts joined pairwise.
    """

    part: int = 4
    whole: int = 5
    words: int = 5
    sample: int = 32
    frequent: int = 4
    frequent_limit: int = 100_000
    nearest: int = 3
    near_part: int = 256
    leaf: int = 16
    fan: int = 8
    block: int = 2_000


#: Groups of the points in trees; pairs are bounded once more by as many as a set needs.
COARSE = 64


def needed(n: np.ndarray, m: np.ndarray, s: Settings) -> np.ndarray:
    """The least overlap with which sets of n and m reach the similarity."""
    return -(-(n + m) * s.part // (s.part + s.whole))


def prefix(shingles: np.ndarray, frequent: np.ndarray, s: Settings) -> np.ndarray:
    """The first shingles of a set, of which similar sets share one."""
    many = len(shingles) - (-(-len(shingles) * s.part // s.whole)) + 1
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    often = frequent[at] == shingles if len(frequent) else np.zeros(len(shingles), bool)
    return shingles[np.argsort(often, kind="stable")[:many]]


def counts_of(shingles: np.ndarray) -> np.ndarray:
    """Group counts: a power of two groups, at least a quarter of the set, so that counts stay small."""
    groups = 16
    while groups * 4 < len(shingles):
        groups *= 2
    while True:
        counts = np.bincount((mixed(shingles) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8)
        groups *= 2


def coarse_of(shingles: np.ndarray) -> bytes:
    """Counts in ``COARSE`` groups: of 8 bits where all fit, else of 32."""
    counts = np.bincount((mixed(shingles) & np.uint64(COARSE - 1)).astype(np.int64), minlength=COARSE)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def coarse_table(rows: list[bytes]) -> np.ndarray:
    """One row of counts for each of ``coarse_of``."""
    out = np.zeros((len(rows), COARSE), np.uint32)
    for size, kind in ((COARSE, np.uint8), (4 * COARSE, "<u4")):
        own = [k for k, r in enumerate(rows) if len(r) == size]
        out[own] = np.frombuffer(b"".join([rows[k] for k in own]), kind).reshape(len(own), COARSE)
    return out


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts in fewer groups: those that are alike in the lower bits go together."""
    return counts.reshape(*counts.shape[:-1], -1, groups).sum(axis=-2, dtype=np.int64)


class Points:
    """Sizes and counts of many sets, folded to as many groups as a comparison needs."""

    def __init__(self, sizes: np.ndarray, counts: list[bytes]):
        self.sizes = sizes
        self.groups = np.fromiter(map(len, counts), np.int64, len(counts))
        self.tables: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(counts), np.int64)
        for g in np.unique(self.groups).tolist():
            own = np.flatnonzero(self.groups == g)
            self.place[own] = np.arange(len(own))
            self.tables[g] = np.frombuffer(b"".join([counts[i] for i in own.tolist()]), np.uint8).reshape(len(own), g)
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def at(self, rows: np.ndarray, groups: int) -> np.ndarray:
        """The counts of ``rows`` in ``groups`` groups, which none has fewer of."""
        out = np.zeros((len(rows), groups), np.uint32)
        for g in np.unique(self.groups[rows]).tolist():
            own = np.flatnonzero(self.groups[rows] == g)
            if (g, groups) not in self.made:
                self.made[g, groups] = folded(self.tables[g], groups).astype(np.uint32)
            out[own] = self.made[g, groups][self.place[rows[own]]]
        return out

    def alike(self, a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
        """Whether sizes and summed minima allow the pairs (a, b) to be similar."""
        n, m = self.sizes[a], self.sizes[b]
        keep = like_sizes(n, n, m, m, s)
        low = np.minimum(self.groups[a], self.groups[b])
        for g in np.unique(low[keep]).tolist():
            own = np.flatnonzero(keep & (low == g))
            for part in np.array_split(own, max(1, len(own) * g // 4_000_000)):
                bound = np.minimum(self.at(a[part], g), self.at(b[part], g)).sum(axis=1, dtype=np.int64)
                keep[part] = bound >= needed(n[part], m[part], s)
        return keep


def like_sizes(least_a, most_a, least_b, most_b, s: Settings) -> np.ndarray:
    """Whether some sizes in two ranges are near enough for similar sets."""
    return (most_a * s.whole >= least_b * s.part) & (most_b * s.whole >= least_a * s.part)


class Forest:
    """R-trees of many blocks at once: level by level, arrays of nodes with sizes, upper corner and children.

    Level 0 are the points, sorted by tree, band of size and first counts; each
    level above has a node for every ``leaf`` or ``fan`` neighbours of a tree, up
    to one root for each tree.
    """

    def __init__(self, tree: np.ndarray, sizes: np.ndarray, counts: np.ndarray, s: Settings):
        band = np.floor(np.log(sizes) / np.log(s.whole / s.part))
        self.rows = np.lexsort((counts[:, 2], counts[:, 1], counts[:, 0], band, tree))
        of, many = tree[self.rows], len(np.unique(tree))
        self.least, self.most, self.upper = [sizes[self.rows]], [sizes[self.rows]], [counts[self.rows]]
        self.begin: list[np.ndarray] = [np.arange(len(of) + 1)]
        while len(self.begin) == 1 or len(of) > many:
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            within = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
            heads = np.flatnonzero(within % (s.leaf if len(self.begin) == 1 else s.fan) == 0)
            self.begin.append(np.r_[heads, len(of)])
            self.least.append(np.minimum.reduceat(self.least[-1], heads))
            self.most.append(np.maximum.reduceat(self.most[-1], heads))
            self.upper.append(np.maximum.reduceat(self.upper[-1], heads, axis=0))
            of = of[heads]

    def join(self, left: np.ndarray, right: np.ndarray, s: Settings, chunk: int = 1 << 15):
        """Pairs of points (rows a, b, bound), one of a tree of ``left`` and one of the tree of ``right`` beside it, that
        the boxes' bounds and their own let through; of one tree each pair once."""
        todo = [(len(self.begin) - 1, left, right)]
        while todo:
            level, i, j = todo.pop()
            if level == 0:
                bound = np.minimum(self.upper[0][i], self.upper[0][j]).sum(axis=1, dtype=np.int64)
                keep = bound >= needed(self.least[0][i], self.least[0][j], s)
                yield self.rows[i[keep]], self.rows[j[keep]], bound[keep]
                continue
            at = self.begin[level]
            n, m = at[i + 1] - at[i], at[j + 1] - at[j]
            ends = np.cumsum(n * m)
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(ends // chunk)) + 1):
                many = (n * m)[part]
                k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                up, width = np.repeat(part, many), np.repeat(m[part], many)
                x, y = at[i[up]] + k // width, at[j[up]] + k % width
                keep = (i[up] != j[up]) | (x < y) | ((x == y) & (level > 1))
                keep &= like_sizes(self.least[level - 1][x], self.most[level - 1][x], self.least[level - 1][y], self.most[level - 1][y], s)
                x, y = x[keep], y[keep]
                if level > 1:
                    bound = np.minimum(self.upper[level - 1][x], self.upper[level - 1][y]).sum(axis=1, dtype=np.int64)
                    keep = bound >= needed(self.least[level - 1][x], self.least[level - 1][y], s)
                    x, y = x[keep], y[keep]
                if len(x):
                    todo.append((level - 1, x, y))


def descended(key: np.ndarray, own: np.ndarray, one: np.ndarray, two: np.ndarray, pos: np.ndarray, apart: np.ndarray, sizes: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (a, b, bound) that trees let through, for many blocks at once.

    Rows with one ``key`` lie together and are a block. Its rows are in parts
    ``one`` and ``two``, as ``own`` tells, and each part is a tree: pairs are of
    one row of each, or of any two where the parts are the same. Rows alike in
    ``apart`` are no pair. ``pos`` is where the block's shingle is in the set: two
    similar sets also share one that leaves enough of either after it, so others
    need not be looked at.
    """
    change = np.r_[True, key[1:] != key[:-1]]
    block = np.cumsum(change) - 1
    tree = 2 * block + (own != one)
    present, index = np.unique(tree, return_inverse=True)
    heads = np.flatnonzero(change)
    both = one[heads] != two[heads]
    wanted = np.stack([2 * np.arange(len(heads)), 2 * np.arange(len(heads)) + both])
    at = np.minimum(np.searchsorted(present, wanted), len(present) - 1)
    whole = (present[at] == wanted).all(axis=0)  # a part may be empty
    forest = Forest(index, sizes, counts, s)
    found = [(np.zeros(0, np.int64),) * 3]
    for a, b, bound in forest.join(at[0][whole], at[1][whole], s):
        n, m = sizes[a], sizes[b]
        keep = (apart[a] != apart[b]) & (np.minimum(n - pos[a], m - pos[b]) >= needed(n, m, s))
        found.append((a[keep], b[keep], bound[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_of(a: np.ndarray, b: np.ndarray, score: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of ids in both directions, for each first the ``many`` best seconds; ties to the smaller id."""
    a, b, score = np.r_[a, b], np.r_[b, a], np.r_[score, score]
    order = np.lexsort((-score, b, a))
    a, b, score = a[order], b[order], score[order]
    fresh = np.r_[np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, score = a[fresh], b[fresh], score[fresh]
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return a[rank < many], b[rank < many], score[rank < many]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32), pa.array(flat))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def frequent_shingles(docs: DataFrame, s: Settings) -> np.ndarray:
    """Hashes, in order, of shingles in many of the sampled sets: at most ``frequent_limit``."""

    def shingles(batches):
        for batch in batches:
            for found in shingle_sets([t or "" for t in batch.column("text").to_pylist()], s.words):
                yield pa.RecordBatch.from_arrays([pa.array([int(mixed(found).sum(dtype=np.uint64).view(np.int64))], pa.int64()), _lists([found])], ["set", "shingles"])

    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(s.sample)) == 0).select("text").mapInArrow(shingles, "set long, shingles array<long>")
    counted = sampled.dropDuplicates(["set"]).select(F.explode("shingles").alias("h")).groupBy("h").count().where(F.col("count") >= s.frequent)
    found = [r["h"] for r in counted.orderBy(F.desc("count"), "h").limit(s.frequent_limit).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def profiles(docs: DataFrame, frequent: np.ndarray, s: Settings) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, keys, counts, coarse``: two hashes of the set, its first shingles, its points."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            n, s1, s2, keys, counts, coarse = [], [], [], [], [], []
            for found in shingle_sets([t or "" for t in batch.column("text").to_pylist()], s.words):
                n.append(len(found))
                s1.append(mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                s2.append(mixed(found + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
                keys.append(prefix(found, hot.value, s) if len(found) else found)
                counts.append(counts_of(found).tobytes())
                coarse.append(coarse_of(found))
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *hashes, _lists(keys), pa.array(counts, pa.binary()), pa.array(coarse, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "keys", "counts", "coarse"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, n_shingles long, s1 long, s2 long, keys array<long>, counts binary, coarse binary")


def in_common(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets in the rows of ``x`` and ``y``, and of what they have in common."""
    n, m = (c.value_lengths().to_numpy() for c in (x, y))
    row = np.r_[np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)]
    value = np.r_[x.flatten().to_numpy(), y.flatten().to_numpy()]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    return n, m, np.bincount(row[1:][twice], minlength=len(n))


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles reach the similarity."""

    def sets(batches):
        for batch in batches:
            found = list(shingle_sets([t or "" for t in batch.column("text").to_pylist()], s.words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(found)], ["id", "set"])

    def compare(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 32):
                part = batch.slice(begin, 32)
                n, m, both = in_common(part.column("x"), part.column("y"))
                yield part.select(["a", "b"]).filter(pa.array(s.whole * both >= s.part * (n + m - both)))

    pairs = written(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    kind = _id_type(docs)
    own = written(docs.select("doc_id", "text").join(ends, "doc_id", "left_semi").mapInArrow(sets, f"id {kind}, set array<long>"))
    left, right = own.select(F.col("id").alias("a"), F.col("set").alias("x")), own.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}").distinct())


def bounded(pairs: DataFrame, points: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that their points' bound lets through."""

    def run(batches):
        for batch in batches:
            size = np.concatenate([batch.column("n").to_numpy(), batch.column("m").to_numpy()])
            both = Points(size, batch.column("x").to_pylist() + batch.column("y").to_pylist())
            rows = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(both.alike(rows, rows + batch.num_rows, s), pa.bool_()))

    left = points.select(F.col("rep").alias("a"), F.col("n").alias("n"), F.col("counts").alias("x"))
    right = points.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("counts").alias("y"))
    near = pairs.join(left, "a").join(right, "b").where(f"n * {s.whole} >= m * {s.part} and m * {s.whole} >= n * {s.part}")
    kind = points.schema["rep"].dataType.simpleString()
    return near.select("a", "b", "n", "m", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def tree_pairs(dealt: DataFrame, points: DataFrame, s: Settings, nearest: int = 0) -> DataFrame:
    """Pairs (a, b) that the trees of blocks let through; with ``nearest`` only that many for each document.

    ``dealt``: key, i, j, own, pos, rep, root. A row is a point of the block (key,
    i, j), in its part ``own``, i or j; see ``descended``.
    """
    kind = points.schema["rep"].dataType.simpleString()
    names = ["key", "i", "j", "own", "pos", "rep", "root", "n", "coarse"]

    def joined(table: pa.Table) -> pa.RecordBatch:
        key, i, j, own, pos, rep, root, n = (table.column(c).to_numpy() for c in names[:8])
        block = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        x, y, bound = descended(block, own, i, j, pos, root, n, coarse_table(table.column("coarse").to_pylist()), s)
        a, b, score = rep[x], rep[y], bound / (n[x] + n[y] - bound)
        if nearest:
            a, b, score = nearest_of(a, b, score, nearest)
        else:
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            a, b, score = pairs[0], pairs[1], np.zeros(pairs.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], ["a", "b", "score"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([*rest, batch] if rest else [batch])
            k, i, j = (table.column(c).to_numpy() for c in names[:3])
            last = np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last block may go on
            if cut:
                yield joined(table.slice(0, cut))
            rest = table.slice(cut).to_batches()
        if rest:
            yield joined(pa.Table.from_batches(rest))

    dealt = dealt.join(points.select("rep", "n", "coarse"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.select(names).mapInArrow(run, f"a {kind}, b {kind}, score double")
    if not nearest:
        return pairs.select("a", "b").distinct()
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    tried = pairs.groupBy("a", "b").agg(F.max("score").alias("score")).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= nearest)
    return tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_blocks(shared: DataFrame, s: Settings) -> DataFrame:
    """Blocks for the nearest points: ``shared`` (key, pos, rep, many) in parts, each with the block's least changed point.

    That is the one with the most shared keys: what the others were copied from.
    """
    parts = F.ceil(F.col("many") / s.near_part).cast("int")
    own = shared.withColumn("own", F.pmod(F.xxhash64("rep"), parts).cast("int")).select("key", "pos", "rep", "own")
    large = shared.where(F.col("many") > s.near_part)
    common = shared.groupBy("rep").agg(F.count("*").alias("_shared"))
    ranked = large.join(common, "rep")
    heads = ranked.groupBy("key").agg(F.max_by(F.struct("pos", "rep"), F.struct("_shared", -F.col("rep"))).alias("_h"), F.max(parts).alias("_parts"))
    heads = heads.select("key", "_h.pos", "_h.rep", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("own"))
    return own.unionByName(heads).select("key", F.col("own").alias("i"), F.col("own").alias("j"), "own", "pos", "rep", F.col("rep").alias("root"))


def all_blocks(members: DataFrame, s: Settings) -> DataFrame:
    """Blocks for all pairs of ``members`` (key, pos, rep, root, many): a block in parts goes to one task for each two parts."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("many") / s.block)).cast("int")
    dealt = members.withColumn("_parts", parts).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.select("key", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "pos", "rep", "root")


def jaccard_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Documents link when their sets of distinct shingles have a Jaccard
    similarity of ``part/whole`` or more; ``component_id`` is the smallest
    doc_id that links reach. A text with fewer words than a shingle is one
    shingle; null texts and those without words have none and are alone. Rows
    that share a doc_id are one document with all their links; doc_id must be
    of an integer type; a null one is alone. Other columns are ignored.
    """
    s = settings
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = written(profiles(docs, frequent_shingles(docs, s), s))
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    first = written(filled.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    ids = first.select(F.col("rep").alias("doc_id"), "s1", "s2")
    reps = filled.join(ids, ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"]).withColumnRenamed("doc_id", "rep")
    with scratch(docs.sparkSession):
        points = written(reps.select("rep", F.col("n_shingles").alias("n"), "counts", "coarse"))

        keyed = reps.select(F.posexplode("keys").alias("pos", "key"), "rep")
        many = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        shared = written(keyed.join(many, "key").select("key", "pos", "rep", "many"))
        links = verified(bounded(tree_pairs(near_blocks(shared, s), points, s, s.nearest), points, s), docs, s)
        roots = written(components(links))

        named = written(shared.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
        torn = named.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
        apart = named.join(torn, "key", "left_semi")
        more = verified(bounded(tree_pairs(all_blocks(apart, s), points, s), points, s), docs, s)
        roots = written(components(links.unionByName(more)), keep=True)

    of = first.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("s1", "s2", F.col("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(of, ["s1", "s2", "n_shingles"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id.

    Of rows that share an id one stays, the first by a hash of its text. Rows
    without an id all stay. All columns are kept.
    """
    found = jaccard_components(docs, settings)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    own = Window.partitionBy("_id").orderBy("_hash")
    packed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    kept = packed.join(first.withColumnRenamed("doc_id", "_id"), "_id", "left_semi").withColumn("_k", F.row_number().over(own)).where("_k = 1")
    return kept.select("_all.*").unionByName(docs.where("doc_id is null"))
