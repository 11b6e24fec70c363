"""The stages keep and drop what brute force says, and run() goes through them all."""

import corpus_pipeline
from trellium.llm import stages

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t)), i)
    kept = stages.drop_copies(spark, docs, FOLDER)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    near = stages.drop_near_copies(spark, docs, FOLDER)
    assert 0 < near.count() <= kept.count()
    clean = stages.drop_contaminated(spark, docs, FOLDER)
    assert 0 < clean.count() < docs.count()


def test_rows_that_tie_leave_one(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b  c", "y"), (None, None, None), (None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = stages.drop_copies(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 1), (True, None)]


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(out.columns) and out.count() > 50
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity"
