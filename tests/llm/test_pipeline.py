"""The corpus pipeline on a small table: each decision takes effect."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len({texts[i] for i in kept}) == len(kept)
    assert not any(item in texts[i] for i in kept for item in items)
    assert sum(labels[i]["quality"] == 0 for i in kept if i in labels) <= 3
    assert sum(labels[i]["toxic"] for i in kept if i in labels) <= 4
    clean = [i for i in labels if labels[i]["quality"] and not labels[i]["toxic"]]
    assert sum(i in kept for i in clean) > 0.6 * len(clean)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_take_odd_rows(spark):
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "MinHash near-dedup"
    row = lambda i, t: (i, t, "en", "s", 3, 0.5, True, "k")
    rows = [row(1, "a b c"), row(None, None), row(2, ""), row(2, ""), row(3, "word " * 30_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, held boolean, row_key string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        left, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        if name == corpus_pipeline.STAGES[-1][0]:
            got = left.collect()
            assert len(got) == 5 and all(r["text_crc32"] == r["decoded_crc32"] for r in got)
        else:
            assert left.columns == docs.columns
            assert set(map(tuple, left.collect())) <= set(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_a_second_run_leaves_the_first_alone(spark):
    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    before = sorted(r["doc_id"] for r in first.select("doc_id").collect())
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in first.select("doc_id").collect()) == before
