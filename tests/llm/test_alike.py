"""The pipeline's near-duplicates, against all pairs."""

import random

import corpus_pipeline
from keyloom.llm import alike


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_are_all_pairs_at_the_similarity(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for n, edits in ((60, 1), (150, 1), (150, 2), (400, 4), (400, 8), (1000, 20), (150, 12)) * 6:
        base = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(3):
            copy = list(base)
            for at in r.sample(range(n), edits):
                copy[at] = r.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    texts += [texts[0].upper(), texts[1], "", "  \n", "one", "one", "two words"]
    own = [sets(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a == b or (a | b and len(a & b) / len(a | b) >= 0.8):
                x, y = root[i], root[j]
                root = [min(x, y) if z in (x, y) else z for z in root]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(root))
    assert alike.keep_one(docs.filter("false")).count() == 0


def test_rows_without_id_or_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s t u v"), (None, None), (7, "")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.text) for r in alike.keep_one(df).collect()) == [(False, ""), (False, "a b c d e"), (True, "q r s t u v")]


def test_simhashes_and_sets_are_those_of_plain_loops():
    import numpy as np
    import pyarrow as pa

    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)) for n in (0, 1, 4, 5, 6, 300, 2000)] + [None, "\n", "A b c d e", "a B  c d e"]
    hashes, bounds = alike.shingle_sets(pa.array(texts))
    own = [sets(t or "") for t in texts]
    for i, a in enumerate(own):
        mine = hashes[bounds[i] : bounds[i + 1]]
        assert len(mine) == len(a) and (np.diff(mine.astype(np.int64)) > 0).all()
        for j, b in enumerate(own):
            assert len(np.intersect1d(mine, hashes[bounds[j] : bounds[j + 1]])) == len(a & b)
    got = alike.simhashes(hashes, bounds, 3)
    for i in range(len(texts)):
        mine = hashes[bounds[i] : bounds[i + 1]]
        for w in range(3):
            bits = [int(x) for x in alike.mixed(mine * alike.TIMES[w])]
            assert int(got[i, w]) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in bits) > len(bits))


def test_large_groups_give_few_candidates():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    n, base = 2000, r.integers(0, 1 << 63, alike.CHECK, np.uint64)
    checks = base[:, None] ^ (np.uint64(1) << r.integers(0, 64, (alike.CHECK, n), np.uint64))
    words = lambda checks: {c: x.view(np.int64) for c, x in zip(alike.CHECKS, checks)}
    batch = pa.record_batch({"key": np.full(n, 7), "node": np.arange(n), **words(checks)})
    rows = [x for b in alike._buckets([batch.slice(0, 700), batch.slice(700)], 34) for x in b.to_pylist()]
    assert sum(x["key"] < 0 for x in rows) == n and sum(x["key"] == 7 for x in rows) == n
    far = pa.record_batch({"key": np.arange(n) // 3, "node": np.arange(n), **words(r.integers(0, 1 << 62, (alike.CHECK, n), np.uint64))})
    assert not [x for b in alike._buckets([far], 20) for x in b.to_pylist()]


def test_rows_of_buckets_are_those_near_another():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(8)
    k = alike.CHECK
    centres = r.integers(0, 1 << 63, (k, 6), np.uint64)
    for n in (3, 60, 150):
        pick = r.integers(0, 9, n)
        flips = np.array([[np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, r.integers(0, 12), np.uint64)) for _ in range(n)] for _ in range(k)], np.uint64)
        checks = np.where(pick < 6, centres[:, np.minimum(pick, 5)] ^ flips, r.integers(0, 1 << 63, (k, n), np.uint64))
        batch = pa.record_batch({"key": np.full(n, 1), "node": r.permutation(n), **{c: x.view(np.int64) for c, x in zip(alike.CHECKS, checks)}})
        rows = [x for b in alike._buckets([batch], 40) for x in b.to_pylist()]
        node, apart = batch.column("node").to_numpy(), np.bitwise_count(checks[:, :, None] ^ checks[:, None, :]).sum(0)
        want = {int(node[i]) for i in range(n) if (apart[i] <= 40).sum() > 1}
        assert {x["node"] for x in rows if x["key"] == 1} == want
        at = {int(v): i for i, v in enumerate(node)}
        pairs = [(x["node"], x["other"], x["check0"]) for x in rows if x["key"] < 0]
        assert all(a != b and apart[at[a], at[b]] == d <= 40 for a, b, d in pairs) and len({a for a, _, _ in pairs}) == len(pairs) <= n
        if n <= alike.SMALL:
            np.fill_diagonal(apart, 999)
            assert {a: d for a, _, d in pairs} == {int(node[i]): apart[i].min() for i in range(n) if apart[i].min() <= 40}


def test_sets_that_go_have_no_partner(spark):
    r = random.Random(7)
    base = list(range(100))
    own = [set(base) - set(r.sample(base, k)) | {1000 * i + j for j in range(k)} for i in range(1, 80) for k in [r.randint(0, 30)]]
    own += [set(range(5000, 5040)), set(range(5000, 5041)), {9}, set(range(7000, 7010))]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(own)], "node long, words array<long>")
    got = {x.node: x for x in alike.linkable(df).collect()}
    for i, a in enumerate(own):
        if any(len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(own) if j != i):
            assert i in got
    assert len(got) < 70 and all(x.shared <= x.n == len(own[i]) for i, x in got.items())


def test_one_signature_reports_a_pair(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    made = alike.shape(1000)
    prints = [[r.getrandbits(64) for _ in range(4)] for _ in range(12)]
    pairs = []
    for p in prints:
        for flips in (0, 1, 8, 20, 40, 60):
            q = list(p)
            for i in r.sample(range(256), flips):
                q[i // 64] ^= 1 << i % 64
            pairs.append((p, q))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    heads = lambda p: {(s << 5 | i, (p[s // 4] >> 16 * (s % 4)) & 0xFFFF & ~(1 << i)) for s in range(16) for i in range(16)}
    df = spark.createDataFrame([(i, *(signed(a ^ b) for a, b in zip(p, q))) for i, (p, q) in enumerate(pairs)], "i int, x0 long, x1 long, x2 long, x3 long")
    got = {x.i: x.head for x in df.select("i", alike._first_signature([F.col(f"x{k}") for k in range(4)], made).alias("head")).collect()}
    for i, (p, q) in enumerate(pairs):
        shared = {h for h, _ in heads(p) & heads(q)}
        assert (got[i] in shared and got[i] >> 5 == min(shared) >> 5) if shared else got[i] is None


def anti_joined(spark, after):
    """Rows that anti joins on a and b have made in executions with larger numbers than `after`, and the last number."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    total, runs = 0, store.executionsList()
    last = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    for k in range(after + 1, last + 1):
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "LeftAnti" in node.desc() and "[a#" in node.desc():
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total, last


def test_copies_just_under_the_similarity_give_few_pairs(spark):
    r = random.Random(11)
    base = [f"b{i}" for i in range(150)]

    def copy(edits):
        out = list(base)
        for at in r.sample(range(5, 40), 1) if edits == 1 else [r.randint(50 + 30 * i, 70 + 30 * i) for i in range(edits)]:
            out[at] = f"own{r.getrandbits(60)}"
        return " ".join(out)

    # Copies with one word of their own are alike; those with three are like none, but near all of them by their checks.
    texts = [copy(1) for _ in range(200)]
    while len(texts) < 250:
        one = copy(3)
        if all(len(sets(one) & b) / len(sets(one) | b) < 0.8 for b in map(sets, texts)):
            texts.append(one)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, before = anti_joined(spark, -1)
    assert sorted(x.doc_id for x in alike.keep_one(docs).collect()) == [0, *range(200, 250)]
    made, last = anti_joined(spark, before)
    assert last > before and made < 1000


def test_parities_exclude_no_pair_that_is_alike(spark):
    import numpy as np

    r = random.Random(12)
    own = []
    for size in (20, 150, 900):
        base = r.sample(range(1 << 48), size)
        for i in range(40):
            k = r.randint(0, size // 5)
            own.append(set(base) - set(r.sample(base, k)) | set(r.sample(range(1 << 48), r.randint(0, k))))
        own += [set(own[-1]) | {1}, set(own[-2]) | {1, 2}]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(own)], "node long, words array<long>")
    live = alike.linkable(df).collect()
    parity = {x.node: np.array([x[c] for c in alike.PARITIES], np.int64).view(np.uint64) for x in live}
    excluded = 0
    for x in live:
        for y in live:
            if x.node < y.node:
                a, b, apart = own[x.node], own[y.node], int(np.bitwise_count(parity[x.node] ^ parity[y.node]).sum())
                assert apart + x.n - x.shared + y.n - y.shared <= len(a ^ b)
                could = alike._can_be_alike(x.n, y.n, x.shared, y.shared, apart, 0.8)
                assert could or len(a & b) < 0.8 * len(a | b)
                excluded += not could
    assert excluded > 100
