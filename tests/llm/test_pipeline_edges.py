"""The pipeline's stages on null, empty, repeated and very long rows, clashing columns and empty tables."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def odd(spark):
    """The given documents and odd ones, with columns whose names operators use inside."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    one = docs.where(F.length("text") > 2000).orderBy("doc_id").first()
    long = " ".join([one["text"]] * 400)
    extra = [(None, "null id " + one["text"], "en", "s"), (900_001, None, None, None), (900_002, "", "en", "s"), (900_003, " \n\t ", "en", "s"), (900_004, long, "en", "s"), (900_005, "twice " + one["text"], "en", "s"), (900_005, "twice " + one["text"], "en", "s")]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
    return docs.unionByName(more).withColumns({"_id": F.lit("kept"), "size": F.lit(7), "label": F.lit(None).cast("string"), "ids": F.lit("x"), "node": F.lit(1.5)})


def test_every_stage_takes_odd_rows(spark, odd, tmp_path):
    docs = odd
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.collect()
        if k < 4:
            # Extra columns come through as they are, and no stage makes rows.
            assert set(docs.columns) == set(before.columns), name
            assert 0 < len(rows[name]) <= before.count(), name
            assert all(r["_id"] == "kept" and r["size"] == 7 and r["label"] is None and r["ids"] == "x" and r["node"] == 1.5 for r in rows[name]), name
    ids = lambda name: sorted((r["doc_id"] for r in rows[name]), key=str)
    assert sum(i == 900_005 for i in ids("near duplicates")) <= 1
    assert ids("secret scans") == ids("near duplicates")
    assert {r["doc_id"] for r in rows["packing"]} == set(ids("secret scans"))
    pieces = {}
    for r in rows["packing"]:
        assert 0 < r["length"] <= 1024
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows["packing"]}
    assert all(pieces[i] == tokens[i] for i in pieces if i is not None)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[1:]])
def test_stages_of_no_rows(spark, odd, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.where("false"), FOLDER).count() == 0
