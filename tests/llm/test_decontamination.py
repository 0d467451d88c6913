import hashlib
import os
import random
import re

import duckdb
import pytest

from fleetspark.llm import decontamination, oracles
from fleetspark.llm.queries import op11_decontamination

DOCS, ITEMS = "doc_id long, text string, w string, row long, items string", "item_id long, text string"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size):
    grams = {}
    for item, text in items:
        w = plain_words(text)
        for s in range(max(len(w) - size + 1, 1) if w else 0):
            grams.setdefault(tuple(w[s : s + size]), set()).add("" if item is None else str(item))
    out = []
    for doc in docs:
        w, hit, found = plain_words(doc[1]), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit |= set(range(s, s + n))
                    found |= grams[g]
        out.append((doc[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), sorted(hit)))
    return out


def rows_of(report):
    fields = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted(((*[r[f] for f in fields], [p - 1 for s in r["spans"] for p in range(s["begin"], s["end"] + 1)]) for r in report.collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "été", "É", "7", "x9", "日本"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-\x00", "_"]) for _ in range(n))
    items = [(rng.choice([1, 2, 2, 30, 4, None]), text(rng.choice([0, 1, 3, 4, 6, 9]))) for _ in range(8)] + [(5, None), (6, ""), (7, "...")]
    docs = [(rng.choice([1, 2, 3, None]), rng.choice(["", ". "]) + text(rng.randint(0, 40)), "clash", 1, "x") for _ in range(25)]
    return docs + docs[:3] + [(9, None, None, None, None), (9, "", None, None, None), (9, "!?", None, None, None), (10, text(3000), "long", 2, "y")], items


@pytest.mark.parametrize(("seed", "size", "bound"), [(1, 4, 1 << 20), (2, 5, 1 << 20), (3, 4, 300), (4, 1, 60)])
def test_equals_brute_force_with_one_part_and_with_many(spark, seed, size, bound):
    docs, items = made(seed)
    report = decontamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), size, bound)
    assert rows_of(report) == sorted(plain(docs, items, size), key=repr)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], ITEMS)
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in decontamination.contamination(docs, items).collect()] == [(2, 0, False)]
    assert decontamination.contamination(docs.limit(0), items).count() == 0


def test_a_passage_in_very_many_documents_and_items(spark):
    shared = " ".join(f"w{i}" for i in range(12))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('x ', '{shared}', ' y', id) AS text")
    items = spark.range(200).selectExpr("id AS item_id", f"concat('{shared}', ' z', id) AS text")
    got = decontamination.contamination(docs, items).selectExpr("min(n_hit)", "max(n_hit)", "min(n_items)", "count(*)").first()
    assert tuple(got) == (12, 12, 200, 3000)


def test_spans_are_cut_and_documents_left_out(spark):
    docs, items = made(5)
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    hits = [p[6] for p in plain(docs, items, 4)]
    cut = decontamination.decontaminate(table, bench, "spans", size=4)
    assert cut.columns == table.columns and cut.count() == len(docs)
    kept = [(d[0], [w for i, w in enumerate(plain_words(d[1])) if i not in hit]) for d, hit in zip(docs, hits)]
    assert sorted((repr(r["doc_id"]), plain_words(r["text"])) for r in cut.collect()) == sorted((repr(a), b) for a, b in kept)
    clean = decontamination.decontaminate(table, bench, "documents", size=4)
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(repr(d) for d, hit in zip(docs, hits) if not hit)
    text = "One two, three four!  Five; six. seven\n"
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    gone = decontamination.decontaminate(one, spark.createDataFrame([(1, "TWO three four five")], ITEMS), size=4)
    assert gone.first()["text"] == "One; six. seven\n"


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    want = con.execute(oracles.DECONTAMINATION_SQL).df()
    got = op11_decontamination(spark, sf_dir).toPandas()
    assert got[want.columns].sort_values("doc_id").reset_index(drop=True).equals(want.sort_values("doc_id").reset_index(drop=True))
    assert got["contaminated"].any()


def test_tables_of_a_query_go_with_its_result(spark, sf_dir):
    import __spark_entry__ as entry
    from fleetspark.llm import common
    from fleetspark.sources import files

    common.clear(spark)
    there = lambda: {x for x in os.listdir(files.shared(spark)) if x.startswith("fleetspark-")}
    before, found = there(), entry.queries()
    kept = found["op11_decontamination"](spark, sf_dir)
    found["op13_source_divergence"](spark, sf_dir)
    assert len(there() - before) > 1 and kept.count() == 200
    del kept
    found["feed_profile"](spark, sf_dir)
    assert there() == before
