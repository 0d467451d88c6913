"""SentencePiece ids and their decoding, through a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character, so
merges never cross from a word into the next marker: a chunk (blanks, then a
word) has the same pieces wherever it stands. Each distinct chunk is segmented
once per worker and the ids of a text are joined from the table by position.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetspark.llm.bpe import gather
from fleetspark.llm.common import in_parts, ship

#: The whitespace marker, which stands for a blank also where a text has it.
MARKER = "▁"
CHUNK = re.compile(r" *[^ ]+| +")


class Pieces:
    """Encoder and decoder of one model; ``limit`` bounds the table of chunks."""

    def __init__(self, path: str, limit: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece has a marker inside: chunks can't be segmented alone")
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.decoded: list[str] = []
        self.flat, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        # Every chunk begins with a blank, and the library puts one before what it encodes.
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        if " " in chunks:  # a marker alone, at the end of a text: the library has no way to encode it by itself
            ids[chunks.index(" ")] = self.model.encode("x ")[len(self.model.encode("x")) :]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        base = len(self.begin)
        self.known.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.begin = np.r_[self.begin, len(self.flat) + np.cumsum(lengths) - lengths]
        self.length = np.r_[self.length, lengths]
        self.flat = np.r_[self.flat, np.fromiter((x for row in ids for x in row), np.uint32, int(lengths.sum()))]
        self.decoded += [" " + self.model.decode(row) for row in ids]

    def encode(self, texts: list[str]):
        """For each text its ids, with begin and end, and what they decode to."""
        model = self.model
        for a, b in in_parts(texts):
            if len(self.known) > self.limit:
                self._forget()
            rows = []
            for text in texts[a:b]:
                text = text.replace(MARKER, " ")
                words = text.split(" ") if text else []
                # Double blanks leave empty words: their markers belong to one chunk with what follows.
                rows.append([" " + w for w in words] if all(words) else CHUNK.findall(" " + text) if text else [])
            if fresh := {c for row in rows for c in row if c not in self.known}:
                self._learn(list(fresh))
            get, decoded = self.known.get, self.decoded
            for row in rows:
                entry = np.fromiter(map(get, row), np.int64, len(row))
                ids = gather(self.flat, self.begin[entry], self.length[entry])
                yield np.r_[np.uint32(model.bos_id()), ids, np.uint32(model.eos_id())], "".join([decoded[i] for i in entry.tolist()])[1:]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """One model per Python worker."""
    return Pieces(path)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded`` of every row of ``docs``.

    Ids are those of the sentencepiece model at the path ``model``, with begin
    and end; null texts count as empty (begin and end alone, decoded to ""). The
    digests are of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8. Repeated rows give repeated results; other columns
    are ignored. Nothing is shuffled.
    """
    return _mapped(docs, model, True)


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """As ``round_trip``, without the columns ids and decoded."""
    return _mapped(docs, model, False)


def _mapped(docs: DataFrame, model: str, whole: bool) -> DataFrame:
    ship(docs.sparkSession)
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * whole)

    def run(batches):
        for batch in batches:
            table = pieces(model)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for ids, text in table.encode(texts):
                row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()]
                rows.append(row + [ids.astype(np.int32), text] if whole else row)
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if whole else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
