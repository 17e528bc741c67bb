"""The pipeline: its stages' contracts, and its result on planted documents."""

import pytest

import corpus_pipeline
from motionloom.llm import jaccard, linededup, quality

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "mixture"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF).cache()
        assert step.columns == docs.columns
        rows[name] = step.count()
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert 0 < len(got) <= rows["decontamination"] <= rows["ngram_jaccard"] <= rows["line_dedup"] == rows["quality_rules"] < 200
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in step.collect()} and all(r["rate"] > 0 for r in got)
    kept = [tuple(r) for r in linededup.drop_document_lines(quality.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet"))).select("doc_id", "text").collect()]
    want = brute.components(kept, 5, 80, 100)
    assert rows["ngram_jaccard"] == sum(c == d for (d, _), (_, c) in want.items())


def test_stages_take_awkward_rows(spark):
    docs = spark.createDataFrame(brute.corpus(), brute.SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() <= docs.count()


@pytest.mark.parametrize("n", [0, 1])
def test_tiny(spark, n):
    docs = spark.createDataFrame(brute.corpus()[:n], brute.SCHEMA)
    assert jaccard.keep_first(docs).count() == n
