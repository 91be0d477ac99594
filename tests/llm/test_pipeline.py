"""The pipeline's stages against what each should keep."""

import corpus_pipeline
from figura.llm import decontaminate, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide_on_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    columns = docs.columns
    rules = {r.doc_id: r.kept for r in quality.host_rules(docs).collect()}
    a = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert a.columns == columns and {r.doc_id for r in a.collect()} == {k for k, v in rules.items() if v}
    b = corpus_pipeline.line_dedup(spark, a, SF).cache()
    assert b.columns == columns and b.count() == a.count()
    assert all(r.n_chars == len(r.text) for r in b.collect())
    c = corpus_pipeline.near_dedup(spark, b, SF).cache()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(b).collect()}
    assert c.columns == columns and {r.doc_id for r in c.collect()} == set(groups.values())
    d = corpus_pipeline.decontamination(spark, c, SF).cache()
    bad = {r.doc_id for r in decontaminate.contamination(c, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert d.columns == columns and {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - bad
    e = corpus_pipeline.bestfit_packing(spark, d, SF).collect()
    assert {r.doc_id for r in e} == {r.doc_id for r in d.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
