"""Operators in column expressions, against brute force on small tables with every awkward row."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import merkle, mixing, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two three four five six one two three four five six",
    "A b\nA b\n\nsection two\nA b\n",
    "é中😀 wörter\n\n\nend",
    "x " * 3000,
    "mail a.b@x.org, b@y.co.uk! 10.0.0.255 256.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (386) 555-3733 +12 34",
    "mail a.b@x.org, b@y.co.uk! 10.0.0.255 256.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (386) 555-3733 +12 34",
    "*** $$$ | < > & # % symbols here and more words than ten in this line of text",
    "9" * 5000 + " " + "a" * 5000 + "@" + "+1" * 2000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", 1, "clash", 2) for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, size int, bucket string, kept int"
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(docs):
    return docs.filter("false")


def test_quality_statistics(docs):
    got = {r.row.doc_id: r for r in quality.text_statistics(docs.select(F.struct("doc_id").alias("row"), "text")).collect()}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_learns_and_keeps_columns(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    text = lambda i, mark: " ".join(f"{words[(i * 7 + j * j) % 19]}{i * j % 11}.{j}{mark}" for j in range(30))
    rows = [(i, text(i, "###" if i % 5 == 0 else ""), i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(0, 200, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).select("row.*", "kept").collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got) and {r.n_words for r in got} == set(range(200))
    assert quality.judge(docs, labels.filter("false")).filter("not kept").count() == 0
    assert quality.judge(docs.filter("false"), labels).count() == 0


def spans(text):
    out = []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark, docs):
    extra = ["a@b.c_x@d.ef", "1.2.3.4.5.6.7.8", "01.002.0003.0000255", "x+1 5555555 1-2 +1.2.3.4", "4111-1111-1111-1111 4111 1111 1111 11114", "a@b a@b. a@.c %+-@-.-.-x", "é4111111111111111é", "+1 (2) 3.4-5 6 7 8 9 0 1 2 3 4 5 6"]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 100)), "doc_id long, text string"))
    for r in more.select("text", pii.digest(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect():
        assert r.s == spans(r.text or ""), r.text[:60]


def test_disclosing_terms_go(spark, docs):
    # A term counts by the contexts that it has beside an entity, so Zorblax stands between words that differ.
    near = ["alpha", "beta", "gamma", "delta", "kappa", "sigma"]
    rows = [(i, f"report {i} by {near[i]} Zorblax about ann@x.org item{i} from the desk {i * 7}") for i in range(6)]
    rows += [(50 + i, f"{w} stays") for i, w in enumerate(near * 3)]
    rows += [(100 + i, f"the desk has report {i} about other things from day {i}") for i in range(60)] + [(None, None), (7, "")]
    got = {r.row.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].clean == "report 0 by alpha  about <EMAIL> item0 from the desk 0"
    assert [s.kind for s in got[0].spans] == ["email", "term"]
    assert got[100].clean == rows[24][1] and got[None].clean is None and got[7].clean == ""
    kept = pii.find_personal_data(docs).select("row.*", "clean").collect()
    assert len(kept) == len(TEXTS) and all(r.bucket == "clash" for r in kept)
    assert pii.find_personal_data(empty(docs)).count() == 0


def test_merkle_edits(docs):
    got = {r.doc_id: r for r in merkle.compare_edits(docs).collect()}
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == edited)
        assert (got[i].first_edit is None) == (t == edited)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[8].fingerprint == got[9].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len(set(texts))
    assert merkle.compare_edits(empty(docs)).count() == 0


def test_merkle_across_buckets(spark):
    rows = [(i * 3, f"text number {i} " * (i % 5 + 1)) for i in range(50)] + [(None, "no id")]
    got = {r.doc_id: r.next_text for r in merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_bucket=7).collect()}
    assert got == {rows[i][0]: rows[(i + 1) % 51][1] for i in range(51) if i < 50} | {None: rows[0][1]} or got[None] in (rows[0][1], "no id")
    assert all(got[i * 3] == rows[i + 1][1] for i in range(49)) and got[147] == "no id"


def test_differing_branches_locate_edits(spark):
    a, b = "one\ntwo\n\nthree\nfour\n", "one\ntwo\n\nthree!\nfour\nfive\n"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(merkle.differing_branches(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d")).first().d
    assert [tuple(x) for x in got] == [(1, 0), (1, 2)]


def fill(sizes, weights, cap=3):
    total, free, fixed = sum(sizes), set(range(len(sizes))), {}
    while True:
        level = (total - sum(fixed.values())) / max(1, sum(weights[i] for i in free))
        over = {i for i in free if weights[i] * level > cap * sizes[i]}
        if not over:
            return [fixed.get(i, weights[i] * level) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}
        free -= over


def test_mix(spark, docs):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(n)), None if i % 9 == 0 else f"s{i % 9}" if i % 9 < 7 or i < 40 else "tiny") for i, n in enumerate(r.integers(0, 60, 900))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = collections.Counter()
    for x in got:
        sizes[x.source] += x.size
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = collections.Counter()
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in names)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert {(x.doc_id, x.taken) for x in got} == {(x.doc_id, x.taken) for x in again}
    whole = mixing.repeat_documents(docs)
    assert whole.columns == docs.columns
    assert mixing.mix(empty(docs)).count() == 0 and mixing.mix(docs).count() == len(TEXTS)


def test_shards(spark, docs):
    rows = [(i * i, "é" * (i * 37 % 101) if i % 10 else None) for i in range(400)] + [(None, "x"), (4, "two rows"), (4, "two rows")]
    for few in (13, 100_000):
        got = sorted(sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16, few).collect(), key=lambda r: (r.shard, r.slot))
        assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
        order = [(-1 if r.doc_id is None else r.doc_id) for r in got]
        assert order == sorted(order)
        total, bytes_, slots = sum(r.size for r in got), collections.Counter(), collections.defaultdict(list)
        for r in got:
            bytes_[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(s == list(range(len(s))) for s in slots.values())
        assert len(bytes_) == 16 and all(abs(b - total / 16) <= 203 for b in bytes_.values())
    assert sharding.assign_shards(docs).count() == len(TEXTS) and sharding.assign_shards(empty(docs)).count() == 0
