import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetspark.llm import common, quality, toxicity
from tests.llm.test_documents import brute
from tests.llm.test_models import corpus

COLUMNS = "doc_id long, text string, score string, predicted string, kept string, n_words string, _row_of_id string, length string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, repeats, copies, near copies and columns named as the models' own; and labels."""
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    rows = corpus(500)
    texts = [(i, t) for i, t, _, _ in rows]
    for i in range(1000, 1040):
        _, text, *_ = rows[1 + 5 * rng.randrange(90)]
        words = text.split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        texts.append((i, " ".join(words)))
    texts += [(2000, None), (2001, ""), (2002, " \n"), (2003, "few words"), texts[3], texts[3], (None, texts[4][1]), (2004, "long " * 3000)]
    docs = spark.createDataFrame([(i, t, "s", "p", "k", None, "r", "l") for i, t in texts], COLUMNS)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, b, q) for i, _, b, q in rows], "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_decide_as_their_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    plain = docs.select("doc_id", "text")

    kept = corpus_pipeline.without_toxic(spark, docs, folder)
    assert kept.schema == docs.schema
    model = toxicity.train(plain, toxicity.learnable(labels, "toxic"))
    good = [(r.doc_id, r.text) for r in toxicity.score(plain, model).where("predicted = 0").collect()]
    assert rows_of(kept) == sorted([(i, t, "s", "p", "k", None, "r", "l") for i, t in good], key=str) and 350 < len(good) < 500

    kept = corpus_pipeline.of_quality(spark, docs, folder)
    model = quality.train(plain, toxicity.learnable(labels, "quality"))
    good = [(r.doc_id, r.text) for r in quality.judge(plain, model).where("kept").collect()]
    assert kept.schema == docs.schema
    assert rows_of(kept) == sorted([(i, t, "s", "p", "k", None, "r", "l") for i, t in good], key=str) and 350 < len(good) < 520

    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, folder)
    found = {i: root for i, _, root in brute(dict((r.doc_id, r.text) for r in plain.where("doc_id is not null").collect()).items())}
    want = sorted([i for i, root in found.items() if i == root] + [None], key=str)
    assert sorted([r.doc_id for r in kept.collect()], key=str) == want and kept.schema == docs.schema


def test_the_whole_pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    ids = {r.doc_id for r in docs.collect()}
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == ids and not ids & {2000, 2001, 2002, 2003, 2004} and len(ids) > 300
    places, starts = defaultdict(list), defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id].append((r.piece, r.start, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for own in starts.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (k, at)
            at += length


def test_stages_of_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_tables_of_a_stage_go(spark, folder):
    from fleetspark.llm import common

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    with common.scratch(spark):
        kept = common.written(corpus_pipeline.one_of_near_duplicates(spark, docs, folder), keep=True)
        inner = list(common._tables[-1])
    fs = spark._jvm.org.apache.hadoop.fs.Path
    there = [fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p)) for p in inner]
    assert inner and not any(there) and kept.where(F.col("doc_id") == 2004).count() == 1


def test_batches_to_workers_are_bounded(spark):
    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    before = spark.conf.get(common.BATCH_BOUND)
    try:
        spark.conf.unset(common.BATCH_BOUND)
        common.ship(spark)
        assert spark.conf.get(common.BATCH_BOUND) == str(common.BATCH_BYTES)
        texts = spark.range(6000, numPartitions=1).select(F.repeat(F.lit("x"), 2000).alias("text"))
        sizes = [r["n"] for r in texts.mapInArrow(measured, "n long").collect()]
        assert sum(sizes) > 6000 * 2000 and max(sizes) < 1.1 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_BOUND, "1m")
        common.ship(spark)
        assert spark.conf.get(common.BATCH_BOUND) == "1m"
    finally:
        spark.conf.set(common.BATCH_BOUND, before)
