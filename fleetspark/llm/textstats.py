"""Counts of character classes over batches of texts, in numpy."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from fleetspark.llm.bpe import code_points
from fleetspark.llm.common import in_parts

#: The characters counted as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CLASSES = ("upper", "letter", "digit", "symbol", "blank", "shout", "mark")


@functools.lru_cache(1)
def _bits() -> np.ndarray:
    """A bit per class of ``CLASSES`` for every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        table[code] = (kind == "Lu") | (kind[0] == "L") << 1 | (kind[0] == "N") << 2 | (kind[0] == "P") << 6
    for k, characters in ((3, SYMBOLS), (4, BLANKS), (5, "!?")):
        for c in characters:
            table[ord(c)] |= 1 << k
    return table


def class_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """For each class, how many characters of each text are in it."""
    out = {name: [np.zeros(0, np.int64)] for name in CLASSES}
    for a, b in in_parts(texts):
        bits = _bits()[code_points("".join(texts[a:b]))]
        ends = np.cumsum([len(t) for t in texts[a:b]])
        for k, name in enumerate(CLASSES):
            total = np.r_[0, np.cumsum((bits >> k) & 1, dtype=np.int64)]
            out[name].append(np.diff(total[np.r_[0, ends]]))
    return {name: np.concatenate(parts) for name, parts in out.items()}
