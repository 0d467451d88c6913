"""Phrases that occur often and stick together, mined from position bitmaps.

The corpus is dealt into shards of one language and a bounded number of words.
In a shard every word has the bitmap of its positions, of which only bytes
that aren't zero are held. A phrase's bitmap, shifted by one position and
ANDed with a word's, is that of the phrase longer by this word; its bits are the
phrase's occurrences. Where a piece ends a position stays empty, so no phrase
goes on into the next piece. Shards hand in numbers of bits, which are summed.

Words and phrases travel as whole numbers. What a shard has of phrases goes to
buckets by a hash of their keys, one row of packed arrays for each bucket, and a
bucket's rows are summed as arrays: no phrase is a row or a Python object until
it is known to be frequent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import ship, written

#: Characters that end a piece, and those between words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_TO = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))

SHARD = "shard long, lang string, words array<string>, counts array<long>, n_words long, sequence binary"
SHARD_ARROW = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("n_words", pa.int64()), ("sequence", pa.binary())])
#: What a shard hands in: phrases of one size in one bucket, by their keys, how often, and where each ends in the sequence.
COUNTS = "lang string, size int, bucket int, shard long, keys binary, counts binary, at binary"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("bucket", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])
#: Frequent phrases, a row each without a shard; and what a shard has of them, by where one ends, with their numbers.
SUMS = "lang string, size int, first long, last long, id long, f long, shard long, at binary, ids binary"
SUMS_ARROW = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("id", pa.int64()), ("f", pa.int64()), ("shard", pa.int64()), ("at", pa.binary()), ("ids", pa.binary())])


class _Shard:
    """Texts of one language as numbers of words, most frequent first when done; -1 where a piece ends."""

    def __init__(self):
        self.ids = defaultdict(None, {b"\n": 0, b"": 1})  # the end of a piece; nothing between two blanks
        self.ids.default_factory = self.ids.__len__
        self.parts, self.size = [], 0

    def add(self, text: bytes) -> None:
        found = text.lower().translate(_TO).replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found))
        numbers = numbers[numbers != 1]
        numbers = np.append(numbers[(numbers != 0) | np.r_[True, numbers[:-1] != 0]], np.int32(0))
        self.parts.append(numbers)
        self.size += len(numbers)

    def row(self, shard: int, lang: str) -> dict:
        numbers, words = np.concatenate(self.parts), list(self.ids)[2:]
        counts = np.bincount(numbers, minlength=len(words) + 2)[2:]
        order = np.argsort(-counts, kind="stable")
        rank = np.full(len(words) + 2, -1, np.int32)
        rank[order + 2] = np.arange(len(words), dtype=np.int32)
        return {"shard": shard, "lang": lang, "words": [words[i].decode("utf-8", "replace") for i in order], "counts": counts[order].tolist(), "n_words": int(counts.sum()), "sequence": packed(rank[numbers])}


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers from -1 on, byte by byte: how many bytes a number has, the low bytes of all, and so on to the highest that any needs."""
    own = (numbers + 1).astype(kind)
    n = max(1, -(-int(own.max(initial=0)).bit_length() // 8))
    return bytes([n]) + own.view(np.uint8).reshape(-1, own.itemsize).T[:n].tobytes()


def unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    own = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    own[:, : data[0]] = planes.T
    return own.view(kind).ravel() - np.dtype(kind).type(1)


def _sharded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 24, 0, {}

        def out(langs):
            nonlocal made
            for lang in langs:
                if held[lang].size:
                    yield pa.RecordBatch.from_pylist([held[lang].row(first + made, lang)], SHARD_ARROW)
                    made += 1
                del held[lang]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = held.setdefault(lang, _Shard())
                shard.add(text)
                if shard.size >= size:
                    yield from out([lang])
            if sum(s.size for s in held.values()) >= 4 * size:  # very many languages
                yield from out(list(held))
        yield from out(list(held))

    return run


class Bitmaps:
    """The positions of each word as bits, in blocks of eight of which those without bits are left out."""

    def __init__(self, numbers: np.ndarray, n_words: int):
        """``numbers``: the word at each position, below 0 for none."""
        at = np.flatnonzero(numbers >= 0).astype(np.int32)
        word, block, bit = numbers[at].astype(np.int32), at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)
        order = np.argsort(word, kind="stable")
        word, block, bit = word[order], block[order], bit[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])]) if len(at) else at
        self.n_words, self.word, self.block = n_words, word[first], block[first]
        self.bits = np.bitwise_or.reduceat(bit, first) if len(at) else bit
        self.begin = np.searchsorted(self.word, np.arange(n_words + 1))
        by_block = np.argsort(self.block, kind="stable")
        self._word, self._bits = self.word[by_block], self.bits[by_block]
        self._begin = np.searchsorted(self.block[by_block], np.arange((len(numbers) >> 3) + 3))

    def groups(self, size: int = 1 << 16) -> Iterator[tuple[int, int]]:
        """Ranges of words with about ``size`` blocks each."""
        a = 0
        while a < self.n_words:
            b = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + size, side="right")) - 1)
            yield a, min(b, self.n_words)
            a = b

    def longer(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """Of phrases' bitmaps, all blocks in one array each: shift them by one position, AND them with each word's.

        Gives phrase, word, block and bits of all blocks that are left, in order of phrase and word.
        """
        over = np.flatnonzero(bits >> 7)
        phrase, block, bits = np.r_[phrase, phrase[over]], np.r_[block, block[over] + 1], np.r_[bits << 1, np.ones(len(over), np.uint8)]
        n = self._begin[block + 1] - self._begin[block]
        at = np.repeat(self._begin[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(np.arange(len(n)), n)
        both = bits[row] & self._bits[at]
        hit = np.flatnonzero(both)
        row, word = row[hit], self._word[at[hit]]
        phrase = phrase[row]
        order = np.argsort(phrase.astype(np.int64) * self.n_words + word, kind="stable")
        return phrase[order], word[order], block[row[order]], both[hit[order]]


def _starts(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1])]) if len(word) else np.zeros(0, np.int64)


def _bit_counts(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


#: The lowest bit of each byte.
_LOWEST = np.array([0, *((x & -x).bit_length() - 1 for x in range(1, 256))], np.int32)


def _ends(block: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The position of each phrase's first bit, that of its last word."""
    return (block[starts] << 3) + _LOWEST[bits[starts]]


def _pairs(numbers: np.ndarray, n_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    maps = Bitmaps(numbers, n_words)
    for a, b in maps.groups():
        own = slice(maps.begin[a], maps.begin[b])
        first, second, block, bits = maps.longer(maps.word[own], maps.block[own], maps.bits[own])
        starts = _starts(first, second)
        yield first[starts], second[starts], _bit_counts(bits, starts), _ends(block, bits, starts)


def pairs(numbers: np.ndarray, n_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of neighbours: first words, second words, how often."""
    for first, second, often, _ in _pairs(numbers, n_words):
        yield first, second, often


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each is in sorted ``keys``, -1 if it isn't."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Chains:
    """Which word may follow: a tree of the allowed phrases, level by level, and for each the node of its words but the first.

    A level is the sorted keys of its nodes, each its parent times ``n_words`` and
    its word, so all is arrays, as many numbers as allowed phrases have words.
    ``part`` is the node of each phrase as given.
    """

    def __init__(self, allowed: np.ndarray | list[tuple[int, ...]], n_words: int):
        parts = np.asarray(allowed, np.int64).reshape(len(allowed), -1) if len(allowed) else np.zeros((0, 0), np.int64)
        self.size, self.n_words = parts.shape[1], n_words
        self.used = np.zeros(n_words + 1, bool)  # the last one is for -1
        self.used[parts.ravel()] = True
        self.levels, node = [], np.zeros(len(parts), np.int64)
        for words in parts.T:
            keys, node = np.unique(node * n_words + words, return_inverse=True)
            self.levels.append(keys)
        self.part, after = node, np.zeros(len(parts), np.int64)
        for keys, words in zip(self.levels, parts.T[1:]):
            after = _find(keys, np.where(after < 0, -1, after * n_words + words))
        self.after = np.full(len(self.levels[-1]) if self.levels else 0, -1, np.int64)
        self.after[node] = after

    def step(self, state: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
        """The node after each word, which makes phrases of ``size`` words: from their last words of the tree's depth, -1 if it may not follow."""
        if size > self.size:
            state = self.after[state]
        return _find(self.levels[min(size, self.size) - 1], np.where(state < 0, -1, state * self.n_words + word))


def _grown(numbers: np.ndarray, chains: Chains, longest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``extensions``: words of the phrases, a column each; nodes of their first and last allowed parts; counts; where one ends.

    Depth first: the phrases that begin with a group of words are extended to their end before the next group's.
    """
    if not chains.size:
        return
    maps = Bitmaps(np.where(chains.used[numbers], numbers, -1), chains.n_words)
    for a, b in maps.groups():
        own = slice(maps.begin[a], maps.begin[b])
        node = chains.step(np.zeros(b - a, np.int64), np.arange(a, b), 1)
        words = np.flatnonzero(node >= 0)
        number = np.full(b - a, -1, np.int64)
        number[words] = np.arange(len(words))
        phrase = number[maps.word[own] - a]
        live = np.flatnonzero(phrase >= 0)
        phrase, block, bits = phrase[live], maps.block[own][live], maps.bits[own][live]
        state = first = node[words]
        paths = (words + a)[:, None]
        for size in range(2, longest + 1):
            phrase, word, block, bits = maps.longer(phrase, block, bits)
            after = chains.step(state[phrase], word, size)
            ok = np.flatnonzero(after != -1)
            phrase, word, block, bits, after = phrase[ok], word[ok], block[ok], bits[ok], after[ok]
            starts = _starts(phrase, word)
            if not len(starts):
                break
            before = phrase[starts]
            paths, state = np.c_[paths[before], word[starts]], after[starts]
            first = state if size <= chains.size else first[before]
            phrase = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(phrase)]))
            if size > chains.size:
                yield paths, first, state, _bit_counts(bits, starts), _ends(block, bits, starts)


def extensions(numbers: np.ndarray, n_words: int, chains: Chains, longest: int) -> Iterator[tuple[list[tuple[int, ...]], np.ndarray]]:
    """Phrases longer than the allowed ones, to ``longest`` words, all of whose parts of that size are allowed, and their counts."""
    for paths, _, _, counts, _ in _grown(numbers, chains, longest):
        yield list(map(tuple, paths.tolist())), counts


def _in_shard(size: int, longest: int, base: int, back: int, buckets: int):
    """Rows of ``COUNTS`` for a shard: its phrases longer than ``size`` words, to ``longest``, whose parts of ``size`` are frequent.

    A phrase's key is ``base`` times the number of its first part, and that of its
    last, which cover it: ``longest`` is at most twice ``size``. Phrases of ``back``
    words will come back, so they say where one is.
    """

    def run(rows: pa.Table) -> pa.Table:
        sequence, own = rows["sequence"].drop_null(), pc.list_flatten(rows["own"]).to_numpy()
        part_at = [unpacked(x.as_py()) for x in rows["at"].drop_null()]
        if not len(sequence) or not len(own) or size > 1 and not part_at:
            return COUNTS_ARROW.empty_table()
        shard, lang = rows["shard"][0].as_py(), rows["lang"].drop_null()[0].as_py()
        numbers, at, word = unpacked(sequence[0].as_py()), own >> 32, own & 0xFFFFFFFF
        names = np.unique(word)
        local = np.full(max(numbers.max(), at.max()) + 2, -1, np.int32)  # the last one is for ends of pieces, -1
        local[at] = np.searchsorted(names, word)
        numbers = local[numbers]
        found: dict[int, list] = {}
        if size == 1:
            for first, second, often, ends in _pairs(numbers, len(names)):
                found.setdefault(2, []).append((names[first] * base + names[second], often, ends))
        else:
            part_at, part_id = np.concatenate(part_at), np.concatenate([unpacked(x.as_py(), "<i8") for x in rows["ids"].drop_null()])
            chains = Chains(numbers[part_at[:, None] + np.arange(1 - size, 1)], len(names))
            number = np.zeros(len(chains.after), np.int64)
            number[chains.part] = part_id
            for paths, first, last, often, ends in _grown(numbers, chains, longest):
                found.setdefault(paths.shape[1], []).append((number[first] * base + number[last], often, ends))
        out = []
        for k, parts in found.items():
            keys, often, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((keys, bucket))
            keys, often, ends = keys[order], often[order], ends[order]
            begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(begin)).tolist():
                x = slice(begin[i], begin[i + 1])
                out.append((lang, k, i, shard, packed(np.diff(keys[x], prepend=0), "<u8"), packed(often[x]), packed(ends[x]) if k == back else None))
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), COUNTS_ARROW.types, strict=True)], schema=COUNTS_ARROW) if out else COUNTS_ARROW.empty_table()

    return run


def _in_bucket(least: int, base: int, back: int, buckets: int):
    """Rows of ``SUMS`` for the phrases of one size in a bucket: those that are frequent get a number each."""

    def run(rows: pa.Table) -> pa.Table:
        lang, size, bucket = (rows[c][0].as_py() for c in ("lang", "size", "bucket"))
        keys = [np.cumsum(unpacked(x.as_py(), "<i8")) for x in rows["keys"]]
        bounds = np.cumsum([0, *map(len, keys)])
        keys, often = np.concatenate(keys), np.concatenate([unpacked(x.as_py()) for x in rows["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        f = np.add.reduceat(often[order], starts)
        frequent = f >= least
        n, number = int(frequent.sum()), np.where(frequent, (np.cumsum(frequent) - 1) * buckets + bucket, -1)
        keys = keys[starts[frequent]]
        none = lambda n, *names: [pa.nulls(n, SUMS_ARROW.field(x).type) for x in names]
        same = lambda n: [pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32))]
        out = [pa.Table.from_arrays([*same(n), pa.array(keys // base), pa.array(keys % base), pa.array(number[frequent]), pa.array(f[frequent]), *none(n, "shard", "at", "ids")], schema=SUMS_ARROW)]
        if size == back and n:
            own = np.empty(len(order), np.int64)
            own[order] = np.repeat(number, np.diff(np.r_[starts, len(order)]))
            shards = []
            for i, (shard, at) in enumerate(zip(rows["shard"].to_pylist(), rows["at"], strict=True)):
                ids = own[bounds[i] : bounds[i + 1]]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    shards.append((shard, packed(unpacked(at.as_py())[hit]), packed(ids[hit], "<u8")))
            columns = [pa.array(x, SUMS_ARROW.field(c).type) for c, x in zip(("shard", "at", "ids"), zip(*shards, strict=True), strict=True)]
            out.append(pa.Table.from_arrays([*same(len(shards)), *none(len(shards), "first", "last", "id", "f"), *columns], schema=SUMS_ARROW))
        return pa.concat_tables(out)

    return run


def _sent(rows: DataFrame, bound: int) -> DataFrame:
    """Rows of a written table, to be sent to all executors if they are few."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def _allowed(had: DataFrame, frequent: DataFrame, value: str, bound: int) -> DataFrame:
    """``shard, allowed``: ``value``, an expression, of what each shard has of ``frequent``.

    Every row of ``had`` is marked, frequent or not, so the join's rows grow as
    what the shards have does, not as shards times frequent phrases.
    """
    marked = had.join(_sent(frequent.withColumn("frequent", F.lit(True)), bound), ["lang", "phrase"], "left")
    return marked.groupBy("shard").agg(F.collect_list(F.when(F.col("frequent"), F.expr(value))).alias("allowed")).where(F.size("allowed") > 0)


def _base(parts: DataFrame) -> int:
    """One more than the largest number of a written table's phrases; two numbers below it make a key of 63 bits."""
    base = (parts.agg(F.max("id")).first()[0] or 0) + 1
    if base**2 >= 1 << 63:
        raise OverflowError(f"numbers of phrases up to {base}: two of them don't fit into a key")
    return base


def _named(more: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """``lang, phrase, size, id, f`` of phrases given by the numbers of their first and last ``parts``, of ``size`` words each."""
    for end in ("first", "last"):
        more = more.join(parts.select("lang", F.col("id").alias(end), F.col("phrase").alias(f"{end}_words")), ["lang", end], "left")
    return more.select("lang", F.expr(f"concat(first_words, ' ', substring_index(last_words, ' ', {size} - size))").alias("phrase"), "size", "id", "f")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, shard_words: int = 1 << 18, broadcast_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all words and phrases up to ``longest`` words with f of ``least`` or more; ``lang, n`` of all words.

    Two tables, written. A phrase can't be frequent unless all its parts are. The
    words' counts come with the shards, and are summed; a shard gets the numbers
    of its frequent words back and counts its pairs; it gets its frequent pairs
    back and extends them to phrases of three; and those depth first to the end
    (beyond six words, to twice their size each time).
    What goes to a shard is what that shard has, so no list of all phrases is held
    anywhere; a table of frequent words is broadcast only if it has ``broadcast_rows``
    at most. Buckets grow in number with the shards, so each holds what some sixteen shards have.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shards = written(texts.mapInArrow(_sharded(shard_words), SHARD))
    buckets = max(16, shards.count() // 16)
    totals = written(shards.groupBy("lang").agg(F.sum("n_words").alias("n")))
    words = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f"))
    words = words.where(F.col("f") >= least).withColumn("part", F.expr("pmod(xxhash64(lang, phrase), 256)"))
    numbers = F.row_number().over(Window.partitionBy("part").orderBy("lang", "phrase")).cast("long")
    words = written(words.select("lang", "phrase", F.lit(1).alias("size"), ((numbers - 1) * 256 + F.col("part")).alias("id"), "f"))
    own = shards.select("shard", "lang", F.posexplode("words").alias("at", "phrase"))
    own = written(_allowed(own, words, "at * 4294967296 + id", broadcast_rows))
    lists = shards.select("shard", "lang", "sequence").unionByName(own.select("shard", F.col("allowed").alias("own")), allowMissingColumns=True)
    held = lists.withColumns({"at": F.lit(None).cast("binary"), "ids": F.lit(None).cast("binary")})
    found, parts, size = words, words, 1
    while size < longest:
        to, base = min(longest, size + 1 if size < 3 else 2 * size), _base(parts)
        back = to if to < longest else 0
        counted = held.groupBy("shard").applyInArrow(_in_shard(size, to, base, back, buckets), COUNTS)
        sums = written(counted.groupBy("lang", "size", "bucket").applyInArrow(_in_bucket(least, base, back, buckets), SUMS))
        more = written(_named(sums.where("shard IS NULL").select("lang", "size", "first", "last", "id", "f"), parts, size))
        found = found.unionByName(more)
        held = lists.unionByName(sums.where("shard IS NOT NULL").select("shard", "at", "ids"), allowMissingColumns=True)
        parts, size = more.where(F.col("size") == to), to
    return written(found.select("lang", "phrase", "size", "f")), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000, shard_words: int = 1 << 18) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases that stick together most.

    Texts are lower-cased (A-Z), cut into pieces at ``ENDS``, and these into words
    at ``BLANKS``. For a phrase of two to ``longest`` words that occurs ``a`` times,
    ``least`` or more, a cut into two parts that occur ``l`` and ``r`` times scores
    floor(1000 * a * n / (l * r)), n being the language's words; its lowest cut
    counts, the first of equal ones. Phrases that never occur but within one
    longer phrase are dropped. Ranks are by score and ``a``, descending, then by
    phrase in order of UTF-8. Exact: products are decimals of 38 digits.

    A null text is empty, a null language ``und``; repeated rows count again; other
    columns are not looked at; empty tables give no rows.
    """
    found, totals = frequent_phrases(docs, least, longest, shard_words)
    inner = found.where("size > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = found.where("size > 1").join(inner, ["lang", "phrase"], "left").where("within IS NULL OR within < f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"), F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    score = F.expr("(1000BD * a_ * n_) div (l_ * r_)")
    scored = cuts.select("*", *[v.alias(f"{c}_") for c, v in whole.items()]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # first within parts of a language, so that no task ranks all of it
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
