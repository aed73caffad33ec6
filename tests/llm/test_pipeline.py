"""The pipeline against its stages' own rules, on the smallest tables."""

import numpy as np

import corpus_pipeline
from panelframe.llm import ngram_join, quality_model, quality_rules, secret_scan


def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_model.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {i for i, t in texts.items() if model.scores([quality_model.passages(t or "")])[0] >= quality_model.THRESHOLD}
    rows = docs.where(docs["doc_id"].isin([*good]))
    judged = {r["doc_id"] for r in quality_rules.judge_narrow(rows).where("_rules.kept").collect()}
    components = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs.where(docs["doc_id"].isin([*judged]))).collect()}
    kept = {i for i, c in components.items() if i == c}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == kept and 0 < len(kept) < len(texts)
    masked = corpus_pipeline.secrets(spark, docs, folder)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert not [s for s in secret_scan.spans(r["text"]) if s[2] == "access"] and r["n_chars"] == len(r["text"])
    lengths = {}
    for r in packed:
        lengths.setdefault(r["sequence_id"], []).append(r["length"])
    full = np.array([sum(v) for v in lengths.values()])
    assert full.max() <= 1024 and sum(1024 - n for n in full if n & (n - 1)) < 0.05 * full.sum()
