"""The pipeline's stages, each held against a plain version on its own input."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
pipeline = pytest.importorskip("corpus_pipeline")

from lumenq.llm import toxicity  # noqa: E402

from . import brute  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
            left = sorted(r.doc_id for r in out.select("doc_id").collect())
        if k == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            want = [r.doc_id for r in toxicity.score_toxicity(docs, model).where("score < 0.3").collect()]
        elif k == 1:
            want = [r[0] for r in brute.equal_texts(before) if r[3]]
        elif k == 2:
            want = list({c for c, _ in brute.similar(before).values()})
        elif k == 3:
            want = [r[0] for r in brute.contamination(before, bench) if not r[5]]
        else:
            assert {r.doc_id for r in out.collect()} == {i for i, _ in before}
            continue
        assert left == sorted(want)
        docs = out


def test_run_gives_the_last_stage(spark):
    got = pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "bin_id", "offset", "length"] and got.count() > 0
