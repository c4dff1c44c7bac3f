"""Decision lists: any rule on any text, and what is learned against plain evaluation."""

import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import quality

NAMES = list(quality.FEATURES)


def measured(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(F.struct("doc_id", "text").alias("row"), "text")
    return quality.text_statistics(rows)


def features(r):
    share = lambda a, b: a / b if b else 0.0
    n = r.n_words
    return [float(n), *(share(x, n) for x in (r.word_chars, r.n_symbols)), share(r.n_dup_lines, r.n_lines), *(share(x, n) for x in (r.n_repeat_words, r.n_capitals, r.n_exclaims, r.n_digits))]


def plain(rules, x):
    return not any(all(x[f] > cut if sign == ">" else x[f] <= cut for f, sign, cut in rule) for rule in rules)


def test_rules_that_use_a_feature_again_hold_on_texts_without_words(spark):
    rules = [[(1, ">", 3.0), (1, "<=", 9.0)], [(1, ">", 0.5), (2, "<=", 0.4), (2, ">", 0.1)], [(3, ">", 0.2), (3, "<=", 0.9)]]
    texts = [None, "", "  \n\t ", "one", "#### $$", "a a a", "line\nline\nline\nother", "x" * 50_000, "word " * 20_000]
    got = measured(spark, texts).withColumn("kept", quality.verdict(rules)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.kept == plain(rules, features(r)), r.row


def test_learned_rules_decide_as_plain_evaluation(spark):
    r = random.Random(3)
    texts = []
    for i in range(400):
        words = [r.choice(["alpha", "Beta", "gamma!", "d3lta", "x"]) + str(r.randint(0, 10**6)) for _ in range(r.randint(10, 60))]
        texts.append(" ".join(f"{w} ##" if i % 3 == 0 and r.random() < 0.6 else w for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (7_000, None), (7_001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(300)] + [(None, 0), (5, None), (7_000, 1), (3, 1)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    assert rules
    got = quality.judge(docs, labels).select("row.doc_id", *(c for c in quality.text_statistics(docs.select(F.struct("*").alias("row"), "text")).columns if c not in ("row", "text")), "kept").collect()
    assert len(got) == 403
    for x in got:
        assert x.kept == (not x.base_failed and plain(rules, features(x)))
    unseen = [x for x in got if x.doc_id is not None and 300 <= x.doc_id < 400]
    assert np.mean([x.kept != (x.doc_id % 3 == 0) for x in unseen]) > 0.95


def test_no_labels_no_rules(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, empty) == [] and [x.kept for x in quality.judge(docs, empty).collect()] == [True]
    assert quality.judge(docs.filter("false"), empty).count() == 0
