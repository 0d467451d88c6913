import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetspark.llm import packing
from fleetspark.llm.bpe import ByteBpe, RankMerger
from fleetspark.llm.pieces import round_trip, round_trip_digests
from fleetspark.llm.token_counts import token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "Hello, world! It's 12 o'clock.", "  two  blanks \n\n\tand\u00a0more ", "we'll 'tis ''s don't're", "x<|endoftext|>y<|endoftext|>", "▁mark ▁▁ two", "日本語 text 😀 e\u0301", "aaaaaaaaaaaaaaa", "a\x00b\r\n", "a\x1cb\x85c"]


def noise(n):
    rng = random.Random(7)
    letters = "ab'stremvld  \n\t1²!?<>|é日▁\u2003"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_merger_takes_overlapping_pairs_from_the_left():
    merger = RankMerger(np.array([0, 2]), np.array([0, 0]), np.array([2, 3]), 4)
    ids, lengths = merger.merge(np.array([0, 0, 0, 1, 0, 0]), np.array([3, 0, 1, 2]))
    assert lengths.tolist() == [1, 0, 1, 1]
    assert ids.tolist() == [3, 1, 2]


def test_ids_are_the_librarys(monkeypatch):
    bpe = ByteBpe(JSON, limit=500)  # the table is emptied on the way
    for part in (TEXTS, noise(800), noise(10) + ["long " * 60_000]):
        ids, counts = bpe.encode(part)
        ends = np.cumsum(counts)
        for text, a, b, e in zip(part, ends - counts, ends, Tokenizer.from_file(JSON).encode_batch(part, add_special_tokens=False)):
            assert ids[a:b].tolist() == e.ids, text
        assert bpe.count(part).tolist() == counts.tolist()


def test_two_pretokens_with_one_hash_are_told_apart():
    bpe = ByteBpe(JSON)
    bpe.multiplier = np.uint64(1)  # "ab" and "ba" collide
    ids, _ = bpe.encode(["ab ba"])
    assert ids.tolist() == Tokenizer.from_file(JSON).encode("ab ba").ids


def test_token_counts(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(0, "", 1), (99, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, JSON, 3).collect()}
    t = Tokenizer.from_file(JSON)
    want = {(i, len((x or "").encode()), len(t.encode(x or "").ids), len(t.encode(x or "").ids) > 3) for i, x, _ in rows}
    assert found == want
    assert token_counts(docs.limit(0), JSON).count() == 0


def test_sentencepiece_round_trip(spark):
    texts = [*TEXTS, *noise(300), None, "w" * 70_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in round_trip(docs, MODEL).collect():
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), sp.decode(ids)), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert round_trip_digests(docs, MODEL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert round_trip_digests(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_and_few_bins(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 40))}
    bins = packing.plan(counts, 64)
    used = defaultdict(int)
    for lengths, n, _ in bins:
        assert 0 < sum(lengths) <= 64 and n > 0
        for x in lengths:
            used[x] += n
    assert used == counts
    assert sum(n for _, n, _ in bins) <= plain_best_fit(counts, 64) + 1


def plain_best_fit(counts, capacity):
    """Bins that best-fit needs, longest first, piece by piece."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - length)
    return len(rooms)


def fewest(pieces, capacity):
    """The least number of bins, by trying everything."""
    best = len(pieces)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + pieces[i] <= capacity:
                put(i + 1, [*bins[:k], bins[k] + pieces[i], *bins[k + 1 :]])
        put(i + 1, [*bins, pieces[i]])

    put(0, [])
    return best


def test_fixed_sets_cost_no_bin():
    rng = random.Random(3)
    for _ in range(150):
        pieces = sorted((rng.randrange(1, 13) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = {x: pieces.count(x) for x in pieces}
        fixed = [(lengths, n) for lengths, n, by in packing.plan(counts, 12) if by]
        rest = list(pieces)
        for lengths, n in fixed:
            for x in lengths * n:
                rest.remove(x)
        assert sum(n for _, n in fixed) + fewest(rest, 12) == fewest(pieces, 12), pieces


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)  # salts within lengths
    texts = [*TEXTS, None, "same", "same", *["a b c"] * 9, "word " * 900]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(13, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    out = packing.best_fit_packing(docs, JSON, end_id=2, capacity=64).collect()
    t = Tokenizer.from_file(JSON)
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.piece].append(r)
    for i in range(len(texts)):
        ids = np.array(t.encode(texts[i] or "").ids + [2], "<u4")
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            own = pieces.pop((i, k))
            assert len(own) == (2 if i == 13 else 1)
            assert all((r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(ids[a:b])) for r in own)
    assert not pieces
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in out) // 64) + 1
    assert packing.best_fit_packing(docs.limit(0), JSON).count() == 0
