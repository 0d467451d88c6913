import os
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from fleetspark.llm import oracles, phrases
from fleetspark.llm.queries import op12_phrases

DOCS = "doc_id long, text string, lang string, phrase string, n long"


def plain(docs, least, longest, top):
    seen, total = Counter(), Counter()
    for doc in docs:
        lang = "und" if doc[2] is None else doc[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), doc[1] or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                seen.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {p: n for p, n in seen.items() if n >= least}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    by_lang = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and not any(x == lang and len(q) > len(p) and inside(p, q) and 100 * b >= 100 * a for (x, q), b in frequent.items()):
            scores = [(1000 * a * total[lang] // (seen[lang, p[:k]] * seen[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(scores)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), seen[lang, p[:k]], seen[lang, p[k:]]))
    out = []
    for lang, rows in by_lang.items():
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "a", "B", "é", "É", "日本", "c\x00", "d-e"])
    text = lambda: "".join(word() + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randint(0, 60)))
    docs = [(i, text(), rng.choice(["en", "en", "fr", None, "und"]), "clash", 1) for i in range(n)]
    docs += docs[:3] + [(7, None, "en", None, None), (8, "", None, None, None), (8, " \t\n", "xx", None, None), (None, "a b a b " * 700, "en", "x", 2)]
    return docs


@pytest.mark.parametrize(("seed", "least", "longest", "top", "size"), [(1, 4, 5, 2000, 1 << 20), (2, 9, 4, 5, 100), (3, 2, 2, 2000, 40), (4, 30, 6, 3, 1000)])
def test_equals_brute_force_in_one_shard_and_in_many(spark, seed, least, longest, top, size):
    docs = made(seed)
    got = phrases.collocations(spark.createDataFrame(docs, DOCS).repartition(3), least, longest, top, size)
    assert sorted(map(tuple, got.collect())) == plain(docs, least, longest, top)


def test_empty_table_and_only_blank_texts(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "..", "en", None, None)], DOCS), least=1).count() == 0


def test_shards_without_any_frequent_pair(spark):
    docs = [(i, "a b a b a b" if i else "x y z w", "en" if i < 9 else "fr", None, None) for i in range(12)]
    got = phrases.collocations(spark.createDataFrame(docs, DOCS).repartition(6), 10, 5, 2000, 6)
    assert sorted(map(tuple, got.collect())) == plain(docs, 10, 5, 2000)
    assert not list(phrases.extensions(np.array([0, 1, -1]), 2, phrases.Chains([], 2), 5))


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    n, f = 3_000_000_000_000_000_001, 1_000_000_007
    found = spark.createDataFrame([("en", "a", 1, 3 * f), ("en", "b", 1, 7 * f), ("en", "a b", 2, f)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (found, spark.createDataFrame([("en", n)], "lang string, n long")))
    assert phrases.collocations(found).first()["score"] == 1000 * f * n // (3 * f * 7 * f)


@pytest.mark.parametrize("size", [2, 3])
def test_bitmaps_shift_over_block_ends_and_stop_at_pieces(size):
    rng = np.random.default_rng(5)
    numbers = rng.integers(-1, 4, 1000)
    maps = phrases.Bitmaps(numbers, 4)
    for a in range(4):
        assert int(np.bitwise_count(maps.bits[maps.begin[a] : maps.begin[a + 1]]).sum()) == int((numbers == a).sum())
    of_size = lambda k: Counter(p for p in (tuple(numbers[i : i + k].tolist()) for i in range(len(numbers) - k + 1)) if min(p) >= 0)
    two = Counter()
    for first, second, often in phrases.pairs(numbers, 4):
        two.update({(a, b): n for a, b, n in zip(first.tolist(), second.tolist(), often.tolist(), strict=True)})
    assert two == of_size(2)
    allowed = {p for p in of_size(size) if sum(p) % 3}
    want = Counter({p: n for k in range(size + 1, 6) for p, n in of_size(k).items() if all(p[i : i + size] in allowed for i in range(k - size + 1))})
    got = Counter()
    for paths, counts in phrases.extensions(numbers, 4, phrases.Chains(sorted(allowed), 4), 5):
        got.update(dict(zip(paths, counts.tolist(), strict=True)))
    assert got == want and any(len(p) == 5 for p in want)
    assert phrases.unpacked(phrases.packed(numbers.astype(np.int32))).tolist() == numbers.tolist()
    assert [w for a, b in maps.groups(100) for w in range(a, b)] == [0, 1, 2, 3]


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(sf_dir, 'documents')}.parquet')")
    want = con.execute(oracles.PHRASE_SQL).fetchall()
    assert sorted(map(tuple, op12_phrases(spark, sf_dir).collect())) == sorted(want) and want


def test_shards_look_up_each_word_once(spark, monkeypatch):
    """No join whose rows are shards times frequent phrases: what a shard has is marked, frequent or not."""
    plans, written = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), written(rows))[1])
    phrases.frequent_phrases(spark.createDataFrame(made(1), DOCS), 4, 5, 100)
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line and "phrase" in line]
    assert joins and all("LeftOuter" in line for line in joins)


def test_a_shard_without_any_frequent_word_counts_nothing(spark):
    had = spark.createDataFrame([(s, "en", w, i) for s in (1, 2, 3) for i, w in enumerate("abc")] + [(4, "fr", "a", 0)], "shard long, lang string, phrase string, at int")
    frequent = spark.createDataFrame([("en", "a", 9), ("en", "c", 9)], "lang string, phrase string, f long")
    for bound in (10, 0):
        assert {r.shard: sorted(r.allowed) for r in phrases._allowed(had, frequent, "at", bound).collect()} == {s: [0, 2] for s in (1, 2, 3)}


def test_tree_of_allowed_phrases_is_arrays():
    """A larger corpus lets nearly all pairs of a shard pass: each may take some numbers of memory, not objects."""
    rng = np.random.default_rng(7)
    allowed = list({tuple(p) for p in rng.integers(0, 30_000, (200_000, 3)).tolist()})
    tracemalloc.start()
    chains = phrases.Chains(allowed, 30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert chains.size == 3 and peak < 200 * len(allowed)


def test_phrases_of_a_shard_are_packed_rows_until_they_are_frequent(spark, monkeypatch):
    """What is written has a row for each frequent phrase and each shard and bucket, not for each phrase of a shard."""
    sizes, written = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda rows: (out := written(rows), sizes.append((out.columns, out.count())))[0])
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(300)), "en", None, None) for i in range(40)]
    found, _ = phrases.frequent_phrases(spark.createDataFrame(docs, DOCS).repartition(2), 9, 5, 1500)
    shards = sizes[0][1]
    assert shards >= 8 and found.where("size = 2").count() < 500
    assert all(n <= 3000 + 16 * shards for _, n in sizes)


@pytest.mark.parametrize("longest", [1, 3, 7, 13])
def test_any_longest_size(spark, longest):
    docs = [(i, "a b c d e f g h i j k l m n o p, b c d, x a b c d e f g " * (i % 3), "en", None, None) for i in range(9)] + [(0, "q r q r q r q r q r q r q r q r q r " * 3, "fr", None, None)]
    got = phrases.collocations(spark.createDataFrame(docs, DOCS).repartition(3), 4, longest, 2000, 60)
    assert sorted(map(tuple, got.collect())) == plain(docs, 4, longest, 2000)
