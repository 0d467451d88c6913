"""Word shingles of batches of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from fleetspark.llm.common import in_parts

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WORD = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(k: int) -> np.ndarray:
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z; blanks between words as in ``BLANK``) and how many each text has."""
    raw = [t.encode("utf-8").lower() for t in texts]  # bytes: only A-Z change
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = BLANK[data]
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    span = np.diff(np.r_[begin, len(data)])
    place = np.arange(begin[0], len(data)) - np.repeat(begin, span)
    powers = _WORD ** np.arange(int(span.max()), dtype=np.uint64)
    value = np.where(blank, 0, data.astype(np.uint64) + np.uint64(1))[begin[0] :] * powers[place]
    hashes = mixed(np.add.reduceat(value, begin - begin[0]))
    heads = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(begin, heads))


def shingle_sets(texts: list[str], k: int = 5):
    """For each text its distinct shingles of ``k`` words, as hashes in order.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    factors = _factors(k)
    for a, b in in_parts(texts):
        words, many = word_hashes(texts[a:b])
        rows = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rows += words[j : j + len(rows)] * factors[j]
        rows = mixed(rows)
        at = 0
        for n in many.tolist():
            if n >= k:
                yield np.unique(rows[at : at + n - k + 1])
            elif n:
                yield mixed((words[at : at + n] * factors[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            at += n
