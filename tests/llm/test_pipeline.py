"""The pipeline over the smallest tables, against its stages applied in memory."""

from __future__ import annotations

import corpus_pipeline

from cadenza.llm import decontaminate, langid, minhash, pieces, secrets
from cadenza.llm.common import documents


def test_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len({r.doc_id for r in out}) == len(out)
    known = {r.doc_id for r in langid.accepted(docs).collect()}
    rest = minhash.one_of_each(docs.filter(docs.doc_id.isin(list(known))))
    rest = secrets.redact(decontaminate.clean(rest, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    want = {r.doc_id: r.text for r in rest.collect()}
    p = pieces.Pieces(pieces.SamplingRules())
    assert {r.doc_id: p.decode(r.ids) for r in out} == want


def test_stages_keep_columns(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_pipeline_of_empty_tables(spark, sf_dir, tmp_path):
    documents(spark, sf_dir).limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() == 0 and out.columns == ["doc_id", "ids"]
    assert pieces.round_trips(documents(spark, f"file://{tmp_path}")).count() == 0
