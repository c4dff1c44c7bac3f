import corpus_pipeline
from keyloom.llm.common import stage

DIR = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, DIR), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3] > 0
    assert docs.filter("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").filter("quality = 1")
    kept = corpus_pipeline.quality_rules(spark, docs, DIR)
    clean = labels.join(docs.filter("size(split(trim(text), '[ \\n]+')) >= 30"), "doc_id")
    assert clean.join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.03 * clean.count()
