"""The pipeline's stages one after another on the smallest table."""

import corpus_pipeline as pipeline
from seekwell.llm import langid, minhash, pii, quality
from seekwell.session import table


def test_stages(spark, sf_dir, no_docs):
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "language ID", "near-duplicates", "PII", "packing"]
    docs = table(spark, sf_dir, "documents")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf_dir).cache()
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    told = stages["language ID"](spark, good, sf_dir).cache()
    least = {r.doc_id for r in langid.identify(good).where("score >= 0.5").collect()}
    assert told.columns == columns and {r.doc_id for r in told.collect()} == least
    single = stages["near-duplicates"](spark, told, sf_dir).cache()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash.near_duplicates(told).where("kept").collect()}
    assert single.count() < told.count()
    private = stages["PII"](spark, single, sf_dir).cache()
    assert private.columns == columns and all(r.n_chars == len(r.text) for r in private.collect())
    assert {r.doc_id: r.text for r in private.collect()} == {r.doc_id: r.text for r in pii.replace(single).collect()}
    packed = stages["packing"](spark, private, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in private.collect()}
    whole = pipeline.run(spark, sf_dir)
    assert sorted(whole.select("doc_id", "start", "ids_crc32").collect()) == sorted(packed.select("doc_id", "start", "ids_crc32").collect())


def test_stages_without_rows(spark, sf_dir, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.isEmpty()
        docs = out if "text" in out.columns else docs


def test_odd_rows_survive(spark, sf_dir, odd_docs):
    docs = odd_docs
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert sorted(docs.columns) == sorted(odd_docs.columns)
    docs.collect()
