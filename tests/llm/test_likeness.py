"""Likeness from the Merkle tree's own branches: an insertion changes only those around it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from keyloom.llm import merkle


def test_an_insertion_keeps_the_other_branches(spark):
    words = [f"word{i}" for i in range(300)]
    run = "".join(f"k{i * i % 997}xyz" for i in range(300))
    pairs = [(" ".join(words), " ".join([*words[:5], "new", *words[5:]])), (" ".join(words), " ".join(words[:5] + words[6:])), (run, run[:500] + "q" + run[500:]), ("\u4e2d\u6587" * 9 + "".join(chr(0x4E00 + i) for i in range(300)), "".join(chr(0x4E00 + i) for i in range(300)))]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(merkle.likeness(merkle.pieces(F.col("a")), merkle.pieces(F.col("b"))).alias("x")).collect()
    assert all(0.95 < r.x < 1 for r in got), got


def leaves(text):
    out = set()
    for paragraph in re.split(r"(?<=\n)(?=[^\n])", text) if text else []:
        atoms = paragraph.split(" ")
        out |= set(zip(atoms, atoms[1:])) if len(atoms) > 1 else {(atoms[0], None)}
    return out


def dice(a, b):
    a, b = leaves(a), leaves(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_likeness_of_edits_and_next_texts(spark):
    """near_edited and near_next against sets of pairs of words; ties, empty, null and long texts, repeated rows."""
    r = random.Random(2)
    text = lambda n: "".join(r.choice(["one", "two", "three", "b\n", "\n\n", "4"]) + r.choice([" ", " ", "  ", "\n"]) for _ in range(n))
    texts = [text(r.randint(0, 60)) for _ in range(40)] + [None, "", "x", "same text here"] + ["same text here"] * 3 + [text(20_000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, tree string").repartition(3)
    got = {x.doc_id: x for x in merkle.compare_edits(docs).collect()}
    texts = [t or "" for t in texts]
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        assert got[i].near_next == pytest.approx(dice(t, after))
        assert got[i].near_edited == pytest.approx(dice(t, t[: len(t) - half] + after[:half]))
