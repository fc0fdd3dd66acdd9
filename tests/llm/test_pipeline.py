"""The pipeline, stage by stage on a small table, each held against its operator's rule."""

from collections import Counter

import corpus_pipeline
from larder.llm import decontam, near_dup, quality


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        new = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert new.columns == columns
        before, after = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in new.collect())
        if i == 0:
            model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert after == Counter(r.doc_id for r in quality.judge(docs, model).collect() if r.kept)
        elif i == 1:
            assert after == Counter(r.doc_id for r in near_dup.near_duplicates(docs).collect() if r.kept)
        elif i == 2:
            bad = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert after == Counter({k: n for k, n in before.items() if k not in bad})
        else:
            assert set(after) <= set(before) and max(after.values()) <= 2
        docs = new
    assert {r.doc_id: r.n_tokens > 0 for r in corpus_pipeline.token_ids(spark, docs, sf).collect()} == {k: True for k in after}


def test_run_on_an_empty_folder(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
