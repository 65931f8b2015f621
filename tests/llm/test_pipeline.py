"""Stages in a row: each works on what the one before kept, and the rows keep the columns of documents."""

import corpus_pipeline
from barframe.llm import mixing, near_dedup, personal_data, quality
from barframe.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        path = scratch_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and docs.dtypes == before.dtypes
        kept[name] = docs
        rows = [r.doc_id for r in docs.collect()]
        if name == "quality rules":
            wanted = [r.doc_id for r in quality.quality(before).filter("kept").collect()]
        elif name == "near duplicates":
            wanted = [r.doc_id for r in near_dedup.near_duplicates(before).filter("kept").collect()]
        elif name == "personal data":
            wanted = [r.doc_id for r in before.collect()]
            assert personal_data.personal_data(docs).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
        else:
            wanted = [r.doc_id for r in mixing.mix(before).collect() for _ in range(r.copies)]
        assert sorted(rows) == sorted(wanted), name
    assert 0 < kept["near duplicates"].count() < kept["quality rules"].count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({r.doc_id for r in packed}) == sorted({r.doc_id for r in docs.collect()})


def test_run_and_no_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "empty")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() == 0
