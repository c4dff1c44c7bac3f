"""Terms that reveal entities, against counts and logarithms in plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from keyloom.llm import pii

RUN = re.compile(r"(?<![^\W_])[^\W\d_](?:['’-]?[^\W\d_]){2,40}(?!['’-]?[^\W\d_]|\d)")


MAIL = r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"


def disclosed(texts, min_texts, min_contexts, least):
    """Flagged terms with their shares, by brute force over the distinct texts."""
    texts = sorted({t or "" for t in texts})
    runs = [RUN.findall(re.sub(MAIL, " ", t.lower())) for t in texts]
    terms = [set(t) for t in runs]
    holders = {}
    for i, t in enumerate(texts):
        found = {"any:email": re.findall(MAIL, t.lower()), "any:ip": re.findall(r"(?<!\d)\d+(?:\.\d+){3}", t), "any:secret": re.findall(r"\b[0-9a-f]{40}\b", t)}
        for kind, values in found.items():
            for entity in {kind for _ in values} | set(values) | {v.split("@")[0] for v in values if kind == "any:email"}:
                holders.setdefault((kind, entity), set()).add(i)
    n, out = len(texts), {}
    for own in holders.values():
        if min_texts <= len(own) < n:
            for term in set().union(*(terms[i] for i in own)):
                both, n_term = sum(term in terms[i] for i in own), sum(term in t for t in terms)
                contexts = {(runs[i][k - 1] if k else "", runs[i][k + 1] if k + 1 < len(runs[i]) else "") for i in own for k, x in enumerate(runs[i]) if x == term}
                share = math.log(both * n / (n_term * len(own))) / math.log(n / len(own))
                if both >= min_texts and len(contexts) >= min_contexts and 2 * len(contexts) >= both and share >= least:
                    out[term] = max(out.get(term, 0), share)
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    people = [(f"{a}{b}", f"ann{i}@{r.choice(['one', 'two'])}.org") for i, (a, b) in enumerate(zip(["zor", "quil", "mar-", "Bel", "ño"], ["blax", "lon", "vik", "gard", "ra"]))]
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    texts = []
    for i in range(300):
        words = [r.choice(common) for _ in range(r.randint(3, 25))]
        if i % 6 == 0:
            name, mail = r.choice(people)
            words += [mail.upper() if r.random() < 0.2 else mail] * r.randint(1, 2)
            if r.random() < 0.85:
                words += [name if r.random() < 0.7 else name.upper()]
        elif i % 47 == 0:
            words += [r.choice(people)[0]]
        r.shuffle(words)
        texts.append(" ".join(words) + ("." if r.random() < 0.5 else ""))
    tilda = [f"{r.choice(common)} tilda {r.choice(common)} 10.0.0.1 {i}" for i in range(8)] + ["tilda alone"]
    copies = [f"quorn stands beside bob{i % 2}@three.org {i}" for i in range(9)]
    keys = [f"{' '.join(r.choice(common) for _ in range(i))} token = \"{r.getrandbits(160):040x}\" {r.choice(common)}" for i in range(9)]
    return texts + tilda + copies + keys + [texts[0], texts[6], None, ""]


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_shares_are_those_of_brute_force(spark, corpus, least):
    want = disclosed(corpus, 3, 5, least)
    assert {"tilda", "token", "zorblax"} <= set(want) and not {"quorn", "stands"} & set(want)
    texts = spark.createDataFrame([(t or "",) for t in corpus], "text string").withColumn("text_hash", F.xxhash64("text")).repartition(3)
    seen = texts.withColumn("spans", pii.protected_spans(F.col("text"))).filter("size(spans) > 0")
    got = pii.disclosing_terms(texts, seen, generalise_at=least).collect()
    assert {r.term for r in got} == set(want)
    assert all(r.share == pytest.approx(want[r.term]) for r in got)
    hashes = {r.text: r.text_hash for r in texts.collect()}
    assert {(r.text_hash, r.term) for r in got} == {(h, t) for text, h in hashes.items() for t in set(RUN.findall(re.sub(MAIL, " ", text.lower()))) & set(want)}


def test_every_document_with_a_term_is_cleaned(spark, corpus):
    want = disclosed(corpus, 3, 5, 0.8)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(corpus)] + [(0, corpus[0], "again")], "doc_id long, text string, terms string")
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(corpus) + 1
    for r in got:
        text = r.row.text or ""
        found = [(m.start(), m.end()) for m in RUN.finditer(text) if m[0].lower() in want]
        found = [(a, b) for a, b in found if not any(s.start < b and a < s.end for s in r.spans if s.kind != "term")]
        assert [(s.start, s.end) for s in r.spans if s.kind == "term"] == found
        assert all(text[s.start : s.end] == s.value for s in r.spans)
        assert not set(RUN.findall((r.clean or "").lower())) & set(want) - {"email", "name", "word", "secret"}


def test_texts_of_many_spans(spark):
    text = " ".join(f"a{i}@b{i}.org {i}.1.2.3" for i in range(5000))
    got = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).first().s
    want = [m.span() for m in re.finditer(r"a\d+@b\d+\.org", text)]
    assert [(s.start, s.end) for s in got if s.kind == "email"] == want
    assert all(text[s.start : s.end] == s.value for s in got) and sum(s.kind == "ip" for s in got) == 256


def test_secrets(spark):
    r = random.Random(2)
    keys = [f"{r.getrandbits(160):040x}" for _ in range(50)] + ["sk-" + "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(40)) for _ in range(50)]
    plain = ["state-of-the-art-methods-of-2020", "a" * 60, "1234567890" * 4, "x1" * 20, "Donaudampfschifffahrtsgesellschaft", "snake_case_name_of_a_function", "", "2024-01-02-03-04-05-06-07-08", "q" * 300_000]
    rows = [(i, f"the key: {k}.") for i, k in enumerate(keys + plain)]
    got = {x.i: x.s for x in spark.createDataFrame(rows, "i int, t string").select("i", pii.protected_spans(F.col("t")).alias("s")).collect()}
    caught = [[(s.kind, s.start, s.end) for s in got[i]] == [("secret", 9, 9 + len(k))] for i, k in enumerate(keys)]
    # Keys of letters with few digits among them are taken for words in part.
    assert all(caught[:50]) and sum(caught[50:]) >= 40
    assert all(not [s for s in got[len(keys) + i] if s.kind == "secret"] for i in range(len(plain)))
