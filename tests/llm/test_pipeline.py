"""The pipeline's stages, one by one and together, on the smallest tables."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, check_packing, jaccard_links, plain_spans, split

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = corpus_pipeline.accept_quality(spark, docs, DATA).cache()
    kept = {r.doc_id for r in good.collect()}
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)
    single = corpus_pipeline.drop_near_duplicates(spark, good, DATA).cache()
    rows = [tuple(r) for r in single.collect()]
    assert not any(jaccard_links(rows))
    clean = corpus_pipeline.sanitise(spark, single, DATA).cache()
    assert all(not plain_spans(r.text) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = corpus_pipeline.mix_sources(spark, clean, DATA).cache()
    total = sum(len(split(r.text)) for r in clean.collect())
    assert abs(sum(len(split(r.text)) for r in mixed.collect()) - 1.5 * total) <= 64 * 2 * 21
    assert mixed.columns == docs.columns == good.columns == single.columns == clean.columns
    check_packing(corpus_pipeline.pack(spark, mixed, DATA).collect(), 2048)


def test_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert got and check_packing(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 2


def test_stages_bear_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, "mail me@x.org now", "en", None, 17)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("size", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() >= 0
        assert stage(spark, docs.limit(0), DATA).count() == 0
    single = corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    assert collections.Counter(r.text for r in single) == {None: 1, "": 1, "a b c d e f": 1, "mail me@x.org now": 1}
