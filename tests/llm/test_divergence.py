import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from fleetspark.llm import divergence, oracles
from fleetspark.llm.queries import op13_source_divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long, value long"


def plain(docs, least, top):
    counts, within, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for doc in docs:
        lang, source = doc[2] or "", doc[3] or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), doc[1] or ""))
        langs[lang].add(source)
        counts[lang, source].update(words)
        within[lang].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in within[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}
        own = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        apart = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(apart(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-apart(own[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, rows, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(sorted(rows)[:limit], 1)]
    return sorted(out)


def made(seed, n=80):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "A", "bB", "été", "É", "日本", "z9z", "rare%d" % rng.randint(0, 30)])
    text = lambda: "".join(word() + rng.choice([" ", "1", "\n", "-\x00"]) for _ in range(rng.randint(0, 30)))
    docs = [(i, text(), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "ß", None]), "clash", 1, 2) for i in range(n)]
    return docs + docs[:4] + [(1, None, "en", "void", None, None, None), (2, "12 .", "xx", "one", None, None, None), (3, None, "xx", "two", None, None, None), (4, "lone", "yy", "only", None, None, None), (5, "a b " * 9000, "fr", "long", None, None, None)]


@pytest.mark.parametrize(("seed", "least", "top", "few"), [(1, 3, 200, 100_000), (2, 1, 4, 0), (3, 6, 1, 100_000)])
def test_equals_brute_force(spark, seed, least, top, few):
    docs = made(seed)
    got = divergence.divergence(spark.createDataFrame(docs, DOCS).repartition(3), least, top, few)
    assert sorted(map(tuple, got.collect())) == plain(docs, least, top)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_very_many_terms_with_one_vector(spark):
    docs = [(i, " ".join(f"x{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}" for k in range(1000)), "en", f"s{i % 2}", "", 0, 0) for i in range(6)]
    docs.append((9, "other other", "en", "s2", "", 0, 0))
    got = divergence.divergence(spark.createDataFrame(docs, DOCS), 3, 5)
    assert sorted(map(tuple, got.collect())) == plain(docs, 3, 5)


def test_counts_are_handed_on_when_too_many_terms_are_held():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a", "b", "a", "a"]), pa.array([b"x y", b"x", b"z x", b"Y y"])], ["lang", "source", "text"])
    total = Counter()
    for out in divergence._count(iter([batch]), limit=2):
        for r in out.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert {k: v for k, v in total.items() if k[1]} == {("a", "x"): 2, ("a", "y"): 3, ("b", "x"): 1, ("a", "z"): 1}


def test_terms_of_a_source_are_summed_before_they_travel(spark):
    docs = [(i, "one two three", "en", f"s{i % 2}", "", 0, 0) for i in range(64)]
    texts = spark.createDataFrame(docs, DOCS).repartition(8).selectExpr("lang", "source", "CAST(text AS binary) AS text")
    got = [tuple(r) for r in divergence._counts(texts).collect()]
    want = [("en", s, t, n, n) for s in ("s0", "s1") for t, n in (("", 0), ("one", 32), ("two", 32), ("three", 32))]
    assert sorted(got) == sorted(want)  # eight times as many rows if each part of the table is counted on its own


@pytest.mark.parametrize("limit", [1, 60, 1 << 24])
def test_counts_of_odd_texts(limit):
    import pyarrow as pa

    rng = random.Random(limit)
    letters = ["a", "B", "É", "é", "\u3000", "\x85", "日本", "z9", "@", "[", "`", "{", "\x7f", "\x00", "\x1c", "\t", "\n", " ", " "]
    docs = [(rng.choice(["", "en"]), rng.choice(["", "x", "ß"]), "".join(rng.choices(letters, k=rng.randint(0, 30)))) for _ in range(200)] + [("void", "", ""), ("blank", "", " 1 ")]
    got, often, within = Counter(), Counter(), Counter()
    batches = [pa.RecordBatch.from_arrays([pa.array([d[0] for d in part], pa.string()), pa.array([d[1] for d in part], pa.string()), pa.array([d[2].encode() for d in part], pa.binary())], ["lang", "source", "text"]) for part in (docs[:0], docs[:7], docs[7:])]
    for out in divergence._count(iter(batches), limit=limit):
        for r in out.to_pylist():
            got[r["lang"], r["source"], r["term"], "n"] += r["n"]
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    for lang, source, text in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        often.update((lang, source, w, "n") for w in words)
        within.update((lang, source, w, "docs") for w in set(words))
        often[lang, source, "", "n"], within[lang, source, "", "docs"] = 0, 0
    assert dict(got) == {**often, **within}


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(sf_dir, 'documents')}.parquet')")
    want = con.execute(oracles.DIVERGENCE_SQL).fetchall()
    assert sorted(map(tuple, op13_source_divergence(spark, sf_dir).collect())) == sorted(want) and want
