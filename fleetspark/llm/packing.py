"""Best-fit packing of token sequences, after a dominance reduction.

Documents are tokenised once; the plan is then made from the histogram of piece
lengths alone, which has at most ``capacity`` rows at any size of the input,
and is applied to the pieces by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.bpe import byte_bpe
from fleetspark.llm.common import ship, written

#: Pieces of one length that are ranked in one task.
RANKED = 50_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids, cut where over ``capacity``.

    The first piece takes what full pieces leave over. Null texts are empty:
    the end id alone.
    """
    ship(docs.sparkSession)

    def cut(batches):
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, counts = bpe.encode(texts)
            ends = np.cumsum(counts)
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                own = np.append(ids[a:b], end_id).astype("<u4")
                edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for k, (p, q) in enumerate(zip(edges, edges[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(p)
                    length.append(q - p)
                    crc.append(zlib.crc32(own[p:q]))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """Bins for ``counts`` pieces of each length: (lengths, how many such bins, fixed by dominance).

    Reduction, from the longest length down: a set with the longest piece is
    fixed where every feasible set with that piece could be exchanged for it
    without a further bin, which holds
    - for the piece alone, if nothing fits beside it;
    - with the longest piece that fits, if that fills the bin or if no two fit;
    - with the longest piece that fits, if three don't fit and no pair that
      fits is longer than it.
    What is left is packed best-fit, longest first. Equal lengths are handled
    at once, so the work depends on the number of lengths, not of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    bins: list[tuple[tuple[int, ...], int, bool]] = []
    lengths = sorted(left)

    def drop(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            lengths.remove(length)

    for longest in sorted(left, reverse=True):
        while left.get(longest):
            room = capacity - longest
            partner = _fit(left, lengths, room, longest)
            n = left[longest]
            if partner is None:
                bins.append(((longest,), n, True))
                drop(longest, n)
                continue
            many = _how_many_fit(left, lengths, room, longest)
            fixed = partner == room or many <= 1 or (many == 2 and partner >= _best_pair(left, lengths, room, longest))
            if not fixed:
                break
            n = n // 2 if partner == longest else min(n, left[partner])
            bins.append(((longest, partner), n, True))
            drop(longest, n)
            drop(partner, n)
    return bins + _best_fit(left, capacity)


def _others(left: dict, longest: int, length: int) -> int:
    """Pieces of ``length`` besides one of ``longest``."""
    return left.get(length, 0) - (length == longest)


def _fit(left: dict, lengths: list, room: int, longest: int) -> int | None:
    """The longest other piece of at most ``room``."""
    at = bisect.bisect_right(lengths, room)
    while at and _others(left, longest, lengths[at - 1]) <= 0:
        at -= 1
    return lengths[at - 1] if at else None


def _how_many_fit(left: dict, lengths: list, room: int, longest: int) -> int:
    """How many of the shortest other pieces fit in ``room`` together, up to 3."""
    many = 0
    for length in lengths:
        for _ in range(min(3, _others(left, longest, length))):
            if length > room or many == 3:
                return many
            room -= length
            many += 1
    return many


def _best_pair(left: dict, lengths: list, room: int, longest: int) -> int:
    """The largest sum of two other pieces within ``room`` (0 if there is none)."""
    best = 0
    own = [x for x in lengths if _others(left, longest, x) > 0]
    low, high = 0, len(own) - 1
    while low <= high:
        a, b = own[low], own[high]
        if a + b > room or (a == b and _others(left, longest, a) < 2):
            high -= 1
        else:
            best = max(best, a + b)
            low += 1
    return best


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """Best-fit, longest first, over classes of equal bins."""
    open_: dict[int, list[list]] = {}  # room -> [[lengths, how many]]
    rooms: list[int] = []

    def put(room: int, lengths: tuple, n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([lengths, n])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fill = max(1, min(n, capacity // length))
                # As many whole new bins of this length as it fills, then one for the rest.
                if full := n // fill:
                    put(capacity - fill * length, (length,) * fill, full)
                if rest := n % fill:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            lengths, many = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            used = min(n, many)
            if many > used:
                put(room, lengths, many - used)
            put(room - length, (*lengths, length), used)
            n -= used
    return [(lengths, n, False) for group in open_.values() for lengths, n in group]


def slots(bins: list[tuple[tuple[int, ...], int, bool]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset, fixed): ranks from there on go to consecutive sequences."""
    rows: dict[int, list[list[int]]] = {}
    ranked: dict[int, int] = {}
    first = 0
    for lengths, n, fixed in bins:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append([ranked.get(length, 0), first, offset, int(fixed)])
            ranked[length] = ranked.get(length, 0) + n
            offset += length
        first += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def ranked_within_length(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, 2 ... within each length, no two alike.

    A length is dealt over as many salts as it has ``RANKED`` pieces, ranked
    within them, and shifted by what the salts before it hold: a length that a
    third of all documents share isn't sorted in one task.
    """
    parts = {length: -(-n // RANKED) for length, n in counts.items() if n > RANKED}
    if not parts:
        salt = F.lit(0)
    else:
        many = F.coalesce(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("length")], F.lit(1))
        salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), many).cast("int")
    salted = pieces.withColumn("_salt", salt)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_rank", F.row_number().over(own) - 1).join(shift, ["length", "_salt"]).withColumn("rank", F.col("_rank") + F.col("_shift")).drop("_salt", "_rank", "_shift")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, fixed``: every piece and its place.

    A document is its ids by the vocabulary at the path ``tokenizer`` and then
    ``end_id``; one longer than ``capacity`` is cut into full pieces after a
    first that may be shorter. Pieces in a sequence lie one after the other
    from offset 0. ``fixed`` tells whether the dominance reduction made the
    sequence. Null and empty texts are pieces of one id; repeated rows are
    packed one by one; an empty table gives no rows; other columns are ignored.
    """
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity))
    # One row per length, so at most ``capacity`` rows come to the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = np.zeros((len(length), 3), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                rows = table[x]
                slot = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                found[own] = np.stack([slot[:, 1] + rank[own] - slot[:, 0], slot[:, 2], slot[:, 3]], axis=1)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(bool))], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fixed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked_within_length(pieces, counts).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fixed boolean")
