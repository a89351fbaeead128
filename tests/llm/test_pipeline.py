"""The pipeline stage by stage against the operators' brute-force facts."""

import corpus_pipeline
from eventide.llm import mixing, queries
from eventide.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "sentencepiece"]
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
        if name == "simhash_near_dedup":
            from test_minhash import components

            assert kept[name] == set(components({r.doc_id: r.text for r in before.collect()}).values())
        if name == "line_dedup":
            assert before.count() == docs.count()
        if name == "mix_sources":
            n = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            taken = {r.id: r for r in mixing.taken_words(before).collect()}
            assert all(1 <= n[i] <= 2 for i in n)
            assert all(abs(n.get(i, 0) - r.taken / max(1, r.size)) <= 1 for i, r in taken.items())
    assert len(kept["language_id"]) >= 0.99 * len(ids)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(final) == docs.count() and all(r.parity and r.decoded for r in final)


def test_run_and_empty(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert set(queries.QUERIES) >= {"op1_simhash_near_dedup", "op10_language_id"}
