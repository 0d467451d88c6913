"""Byte-level BPE over batches of pre-tokens, merged rank by rank in numpy.

``RankMerger`` holds a batch of pre-tokens as one ragged array of symbols. In
each round every sequence finds its lowest-rank neighbouring pair and all
sequences apply theirs at once; what is left when no sequence has a pair are
the tokens. ``ByteBpe`` adds the vocabulary file, the pre-tokenising and a
bounded table of pre-tokens seen, so that each distinct one is merged once.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np

from fleetspark.llm.common import in_parts

#: No merge.
NONE = np.int64(1) << 40
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points with Unicode's White_Space property, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: What may follow an apostrophe as a token of its own.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@functools.lru_cache(1)
def character_classes() -> np.ndarray:
    """The pre-tokeniser's class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    for low, high in WHITE_SPACE:
        table[low : high + 1] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pretoken_starts(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in ``points``, a row of segments that begin at ``heads``.

    Runs of letters, numbers and other signs are pre-tokens and take one blank
    before them along; white space before that is one of its own, and so is a
    short English ending after an apostrophe that begins a pre-token.
    """
    size = len(points)
    if not size:
        return np.zeros(0, np.int64)
    kind = character_classes()[points]
    edge = np.zeros(size + 1, bool)
    edge[heads] = True
    edge[size] = True
    run = np.empty(size + 1, bool)
    run[0], run[size] = True, True
    np.not_equal(kind[1:], kind[:-1], out=run[1:size])
    run |= edge
    start = run[:size].copy()
    space = kind == SPACE
    # The last white space before a run: its own pre-token, or part of the run.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:size])
    start[last] = True
    blank = last[points[last] == 0x20]
    start[blank + 1] = False
    # Endings after an apostrophe that stands alone and begins a pre-token.
    mark = np.flatnonzero((points == 0x27) & start)
    mark = mark[mark + 1 < size]
    mark = mark[run[mark + 1] & ~edge[mark + 1] & (kind[mark + 1] == LETTER)]
    if len(mark):
        short = np.isin(points[mark + 1], [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(mark), bool)
        two = (mark + 2 < size) & ~run[np.minimum(mark + 2, size)]
        for a, b in LONG_ENDINGS:
            long |= two & (points[mark + 1] == ord(a)) & (points[np.minimum(mark + 2, size - 1)] == ord(b))
        start[mark[short | long] + 1] = False
        for end in (mark[short] + 2, mark[long] + 3):
            start[end[end < size]] = True
    return np.flatnonzero(start)


class RankMerger:
    """Merges ragged batches by a table of pairs; ``merge(symbols, lengths)`` gives ids and lengths."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, vocabulary: int):
        key = left.astype(np.int64) * vocabulary + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.vocabulary = key[order], order.astype(np.int64), vocabulary
        self.made = made.astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.vocabulary + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every sequence of ``lengths`` symbols, fully merged. Empty sequences stay empty."""
        symbols, rows = symbols.astype(np.int64), len(lengths)
        row = np.repeat(np.arange(rows), lengths)
        rank = np.full(len(symbols), NONE)
        same = np.flatnonzero(row[1:] == row[:-1])
        rank[same] = self._ranks(symbols[same], symbols[same + 1])
        out_symbols, out_rows = [], []
        while len(symbols):
            head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.r_[head, len(symbols)])
            if (best == NONE).sum() * 8 > len(best):  # sequences without a pair are done
                busy = np.repeat(best < NONE, size)
                out_symbols.append(symbols[~busy])
                out_rows.append(row[~busy])
                symbols, row, rank = symbols[busy], row[busy], rank[busy]
                best, size = best[best < NONE], size[best < NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero((rank == np.repeat(best, size)) & (rank < NONE))
            # Of overlapping pairs (only x,x,x has them) each second one counts, from the left.
            fresh = np.r_[True, np.diff(at) != 1]
            if not fresh.all():
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, row, rank = symbols[keep], row[keep], rank[keep]
            # Only the pairs on either side of a merged symbol have a new rank.
            at -= np.arange(len(at))
            near = np.r_[at, at[at > 0] - 1]
            rank[near] = NONE
            near = near[near + 1 < len(symbols)]
            near = near[row[near] == row[near + 1]]
            rank[near] = self._ranks(symbols[near], symbols[near + 1])
        if not out_symbols:
            return np.zeros(0, np.int64), np.zeros(rows, np.int64)
        symbols, row = np.concatenate(out_symbols), np.concatenate(out_rows)
        order = np.argsort(row, kind="stable")
        return symbols[order], np.bincount(row, minlength=rows)


def byte_letters() -> dict[int, str]:
    """The printable letter that vocabulary files of this kind write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``flat[begin:begin+length]``, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin - (ends - length), length)]


class ByteBpe:
    """Encoder for one vocabulary file; ``limit`` bounds the table of distinct pre-tokens."""

    def __init__(self, path: str, limit: int = 1_000_000):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocabulary = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        ids = lambda words: np.array([vocabulary[w] for w in words], np.int64)
        self.merger = RankMerger(ids(a for a, _ in pairs), ids(b for _, b in pairs), ids(a + b for a, b in pairs), max(vocabulary.values()) + 1)
        self.byte_id = np.array([vocabulary[c] for _, c in sorted(byte_letters().items())], np.int64)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.specials = {t: i for i, t in enumerate(self.special)}
        self.limit, self.multiplier = limit, np.uint64(0x9E3779B97F4A7C15)
        self._forget()

    def _forget(self) -> None:
        """Empty the table; its first entries are the special strings."""
        self.mark, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their entries
        self.points, self.from_, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add(np.zeros(0, np.uint32), np.zeros(len(self.special), np.int64), np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64))

    def _add(self, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.from_ = np.r_[self.from_, len(self.points) + np.cumsum(sizes) - sizes]
        self.size, self.points = np.r_[self.size, sizes], np.r_[self.points, points]
        self.begin = np.r_[self.begin, len(self.flat) + np.cumsum(lengths) - lengths]
        self.length, self.flat = np.r_[self.length, lengths], np.r_[self.flat, ids.astype(np.int32)]

    def _learn(self, marks: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> None:
        """Merge new pre-tokens, given by code points, and enter them."""
        joined = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8")
        wide = np.searchsorted([0x80, 0x800, 0x10000], points, side="right") + 1  # bytes of a character
        symbols = self.byte_id[np.frombuffer(joined, np.uint8)]
        ids, lengths = self.merger.merge(symbols, sums(wide, sizes))
        entry = len(self.size) + np.arange(len(sizes))
        self._add(points, sizes, ids, lengths)
        spot = np.searchsorted(self.mark, marks)
        self.mark, self.at = np.insert(self.mark, spot, marks), np.insert(self.at, spot, entry)

    def _lookup(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entries of the pre-tokens that begin at ``starts``."""
        sizes = np.diff(np.r_[starts, len(points)])
        while True:
            powers = self.multiplier ** np.arange(int(sizes.max(initial=1)), dtype=np.uint64)
            place = np.arange(len(points)) - np.repeat(starts, sizes)
            marks = np.add.reduceat((points + np.uint64(1)) * powers[place], starts)
            marks ^= marks >> np.uint64(29)
            distinct, first, back = np.unique(marks, return_index=True, return_inverse=True)
            spot = np.searchsorted(self.mark, distinct)
            fresh = np.ones(len(distinct), bool)
            inside = spot < len(self.mark)
            fresh[inside] = self.mark[spot[inside]] != distinct[inside]
            if fresh.any():
                new = first[fresh]
                self._learn(distinct[fresh], gather(points, starts[new], sizes[new]), sizes[new])
                spot = np.searchsorted(self.mark, distinct)
            entry = self.at[spot][back]
            if (self.size[entry] == sizes).all() and (gather(self.points, self.from_[entry], sizes) == points).all():
                return entry
            # Two pre-tokens share a hash: start again with another multiplier.
            self.multiplier = self.multiplier * np.uint64(6364136223846793005) + np.uint64(1442695040888963406)
            self._forget()

    def _segments(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Texts cut at special strings: pieces, their text, and the entry of a special piece (else -1)."""
        pieces, owner, entry = [], [], []
        for i, text in enumerate(texts):
            rest = text
            while rest:
                found = min(((rest.find(s), -len(s), s) for s in self.special if s in rest), default=None)
                cut = found[0] if found else len(rest)
                if cut:
                    pieces.append(rest[:cut])
                    owner.append(i)
                    entry.append(-1)
                if found:
                    pieces.append("")
                    owner.append(i)
                    entry.append(self.specials[found[2]])
                rest = rest[cut - found[1] :] if found else ""
        return pieces, owner, entry

    def _entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of all pre-tokens, and how many each text has."""
        if len(self.size) > self.limit:
            self._forget()
        pieces, owner, special = self._segments(texts)
        points = code_points("".join(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        heads = np.cumsum(sizes) - sizes
        starts = pretoken_starts(points, heads[sizes > 0])
        found = self._lookup(points, starts) if len(starts) else np.zeros(0, np.int64)
        special, owner = np.array(special, np.int64), np.array(owner, np.int64)
        of = owner[np.searchsorted(heads + sizes, starts, side="right")] if len(starts) else np.zeros(0, np.int64)
        if (special >= 0).any():  # special pieces are empty strings between their neighbours
            at = np.flatnonzero(special >= 0)
            place = np.searchsorted(starts, heads[at], side="left")
            found, of = np.insert(found, place, special[at]), np.insert(of, place, owner[at])
        return found, np.bincount(of, minlength=len(texts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in in_parts(texts):
            entry, many = self._entries(texts[a:b])
            length = self.length[entry]
            ids.append(gather(self.flat, self.begin[entry], length))
            counts.append(sums(length, many))
        return np.concatenate(ids), np.concatenate(counts)

    def count(self, texts: list[str]) -> np.ndarray:
        """Each text's number of ids."""
        counts = [np.zeros(0, np.int64)]
        for a, b in in_parts(texts):
            entry, many = self._entries(texts[a:b])
            counts.append(sums(self.length[entry], many))
        return np.concatenate(counts)


def sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive groups of ``many`` values."""
    total = np.r_[0, np.cumsum(values)]
    end = np.cumsum(many)
    return total[end] - total[end - many]


@functools.lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per Python worker."""
    return ByteBpe(path)
