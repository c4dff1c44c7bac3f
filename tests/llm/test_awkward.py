"""Rows that a corpus has somewhere: nulls, empties, repeats, ties, very long texts, clashing columns, no rows at all."""

import random

import pytest

import corpus_pipeline
from keyloom.llm import chaining, langid
from keyloom.llm.common import stage

WORDS = {"en": "the and of with that this from have people water", "de": "der und die mit das nicht ein auch wasser haus", "es": "el que los para una por con del agua casa"}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    name = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda lang, n: " ".join(r.choice(WORDS[lang].split()) if r.random() < 0.4 else name() for _ in range(n)) + "."
    rows = [(i, text(lang, r.randint(30, 90)), lang, f"s{i % 4}") for i, lang in enumerate(sorted(WORDS) * 40)]
    rows += [(200, None, "en", "s1"), (201, "", None, "s1"), (202, " \n\t ", "en", None), (203, "one", "en", None), (None, text("en", 60), "en", "s2"), (None, None, None, None)]
    rows += [rows[3], rows[3], (204, rows[5][1], "de", "s0"), (205, rows[5][1].upper(), "de", "s0"), (206, text("en", 30_000), "en", "s9"), (207, "x" * 200_000, "en", "s9"), (208, rows[7][1] + " mail ann.lee@mail.org", "en", "s3")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def test_pipeline_takes_every_row(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus, SCHEMA).selectExpr("*", "length(text) AS n_chars").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(100)] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, str(tmp_path)), "awkward")
        assert now.columns == docs.columns and now.count() > 0, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.select("doc_id").collect()}
    assert not now.filter("text like '%@mail%'").count()


def test_pipeline_of_no_rows(spark, corpus, tmp_path):
    spark.createDataFrame(corpus[:1], SCHEMA).selectExpr("*", "length(text) AS n_chars").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_beside_clashing_columns(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    clash = docs.selectExpr("*", "1 AS a", "2 AS b", "3 AS h", "4 AS key", "5 AS chain", "6 AS start", "7 AS source_id")
    want = sorted(map(tuple, chaining.repeated_passages(docs).collect()))
    assert want and sorted(map(tuple, chaining.repeated_passages(clash).collect())) == want
    assert (204, 5) in {(r[0], r[3]) for r in want} and (205, 5) in {(r[0], r[3]) for r in want}


def test_languages_of_every_row(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = langid.identify(docs.selectExpr("*", "1 AS held_out", "2 AS score", "3 AS x")).collect()
    assert len(got) == len(corpus)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 9)))
    assert all(len(v) == 1 for i, v in by.items() if i is not None) and by[206] != {("und", 0.0)}
    assert all(by[i] == {("und", 0.0)} for i in (200, 201, 202))
    assert langid.identify(docs.filter("false")).count() == 0


def test_many_language_values_stay_bounded(spark, corpus):
    docs = spark.createDataFrame([(i, f"word{i % 9} number {i}", f"l{i % 300:03d}") for i in range(900)] + [(i, "the and of with", "en") for i in range(900, 960)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert sum(len(m.classes) for m in model.within.values()) <= langid.MAX_LANGUAGES
