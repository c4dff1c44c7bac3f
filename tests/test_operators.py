import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import bitvector, evaluate, prefix, recsplit, retrieval, shockhash, shockrecsplit, sichash
from keyloom.plans.persist import persist
from keyloom.sources import keys as key_sources
from keyloom.streaming.lookup import lookup_stream

from .conftest import rows

ONES, NIBBLES = [2**64 - 1] * 2, [0x0F0F0F0F0F0F0F0F] * 2


def bits_of(spark, words):
    return spark.createDataFrame([(64 * i + j, w >> j & 1) for i, w in enumerate(words) for j in range(64)], "pos long, bit int")


def test_select_and_rank_goldens(spark):
    for words, select, rank in (
        (ONES, {0: 0, 3: 2, 13: 12, 65: 64, 111: 110}, {3: 4, 13: 14, 64: 65}),
        (NIBBLES, {1: 0, 3: 2, 5: 8, 8: 11, 32: 59, 36: 67, 48: 91}, {2: 3, 8: 5, 11: 8, 59: 32, 67: 36, 91: 48}),
    ):
        bits = bits_of(spark, words)
        asked = spark.createDataFrame([(r,) for r in select], "r long")
        assert dict(rows(bitvector.select_at(bits, asked).select("r", "pos"))) == select
        got = {r.pos: r for r in bitvector.with_rank(bits).collect()}
        assert {p: got[p].rank_inclusive for p in rank} == rank
        packed = bitvector.pack_words(bits)
        assert sorted(r.word & (2**64 - 1) for r in packed.collect()) == sorted(words)
        assert rows(bitvector.unpack_words(packed)) == rows(bits)
        assert {r.pos: r.rank for r in bitvector.rank9_at(packed, bits.select("pos")).collect()} == {p: r.rank for p, r in got.items()}


def test_prefix_crosses_blocks(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(0, 3000, 7)], "k long, v long")
    got, total = {r.k: r.v_before for r in prefix.exclusive_prefix(df, "k", ["v"], block_bits=6).collect()}, 0
    for k in range(0, 3000, 7):
        assert got[k] == total
        total += k % 5


@pytest.mark.parametrize("n,bits", [(0, 1), (1, 2), (64, 1), (10_000, 2), (1_000, 3)])
def test_ribbons_give_back_values(n, bits):
    r = np.random.default_rng(n)
    h, v = r.integers(0, 2**63, n).astype(np.uint64), r.integers(0, 1 << bits, n)
    assert (retrieval.query_bumped([retrieval.build_ribbon(h, v, bits, 0.25)], h) == v).all()
    assert (retrieval.query_bumped(retrieval.build_bumped(h, v, bits), h) == v).all()


def test_bumping_with_overload_and_contradictions():
    r = np.random.default_rng(0)
    h, v = r.integers(0, 2**63, 20_000).astype(np.uint64), r.integers(0, 4, 20_000)
    layers = retrieval.build_bumped(h, v, 2, 64, -4 / 64, 5)
    assert (retrieval.query_bumped(layers, h, 64, -4 / 64) == v).all()
    same = np.array([5, 5], np.uint64)
    assert (retrieval.query_bumped([retrieval.build_ribbon(same, np.array([1, 1]), 1)], same) == 1).all()
    with pytest.raises(ValueError):
        retrieval.build_ribbon(same, np.array([0, 1]), 1)


def test_recsplit_kernel():
    assert [recsplit.fanout(*a) for a in ((500, 12), (1000, 8), (2000, 16), (100, 12), (30, 8))] == [[480, 20], [576, 424], [1120, 880], [60, 40], [8, 8, 8, 6]]
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 8, 9, 100, 333):
        h1, h2 = (r.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        nodes = recsplit.split(h1, h2, 6)
        fixed, unary = recsplit.encode(nodes, 6)
        assert recsplit.subtree(n, 6) == (len(nodes), len(fixed))
        assert sorted(recsplit.Tree(fixed, unary, 6).values(h1, h2, n).tolist()) == list(range(n))


def test_shockhash_kernels():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 16, 21):
        h1, h2 = (r.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        seed, _, choice = shockhash.solve_plain(h1, h2)
        own = [recsplit.place(h1, h2, np.array([2 * seed + c]), n)[0] for c in (0, 1)]
        assert sorted(own[c][k] for k, c in enumerate(choice)) == list(range(n))
        a, b, choice = shockhash.solve_bipartite(h1, h2)
        half = n - n // 2
        own = [recsplit.place(h1, h2, np.array([2 * a]), half)[0], half + recsplit.place(h1, h2, np.array([2 * b + 1]), max(1, n // 2))[0]]
        assert sorted(own[c][k] for k, c in enumerate(choice)) == list(range(n))


def test_orientation_refuses_what_cannot_be():
    assert shockhash.orient([0, 0, 1], [1, 1, 0], 3) is None
    assert sorted([a if c == 0 else b for a, b, c in zip([0, 1, 2], [1, 2, 0], shockhash.orient([0, 1, 2], [1, 2, 0], 3))]) == [0, 1, 2]


KEYS = ["", "a", "é中😀", *(f"key {i}" for i in range(300)), "x" * 500]


def keys_of(spark, names):
    return spark.createDataFrame([(k,) for k in names], "key string")


@pytest.mark.parametrize("names", [[], ["only"], KEYS], ids=["none", "one", "many"])
def test_hash_functions_are_minimal(spark, names):
    keys, n = keys_of(spark, names), len(names)
    plan = recsplit.Plan(bucket_size=40, leaf=6)
    artifact = persist(recsplit.build(keys, plan, n), "t")
    assert sorted(r.mph for r in recsplit.lookup(keys, artifact, plan, n).collect()) == list(range(n))
    built = sichash.build(keys, sichash.Plan(bucket_size=100), n, persist)
    assert sorted(r.mph for r in sichash.lookup(keys, built).collect()) == list(range(n))
    paired = shockrecsplit.build(keys, recsplit.Plan(bucket_size=40, leaf=12), n, persist)
    assert sorted(r.mph for r in shockrecsplit.lookup(keys, paired).collect()) == list(range(n))
    for bipartite in (False, True):
        made = shockhash.build(keys, shockhash.Plan(bucket_size=12, bipartite=bipartite), n, persist)
        assert sorted(r.mph for r in shockhash.lookup(keys, made).collect()) == list(range(n))


def test_repeated_keys_show_or_raise(spark):
    plan = shockhash.Plan(bucket_size=12)
    pairs = spark.createDataFrame([("a", 0), ("a", 1)], "key string, value long")
    with pytest.raises(Exception, match="no seed gives a consistent system"):
        retrieval.build_retrieval(pairs, 1, 1, "ribbon").collect()
    assert key_sources.distinct_keys(keys_of(spark, ["a", "a", None]), "key").count() == 1
    assert plan.buckets(0) == 1


def test_sources(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("b\na\nb\n")
    assert rows(key_sources.read_lines(spark, str(tmp_path / "lines.txt"))) == [("a",), ("b",)]
    keys = key_sources.random_keys(spark, 500)
    assert keys.distinct().count() == 500
    assert rows(key_sources.dedupe_lines(spark.createDataFrame([(" a\nb",), ("a",)], "t string"), "t")) == [("a",), ("b",)]
    report = evaluate.space_report(spark.createDataFrame([("x", 6), ("y", 4)], "component string, bits long"), 5)
    key_sources.write_report(report, str(tmp_path / "report"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "report"))) == [("x", "6", "10", "2.0"), ("y", "4", "10", "2.0")]


def test_evaluation(spark):
    got = evaluate.verify(spark.createDataFrame([(0,), (1,), (1,)], "mph long")).first()
    assert tuple(got) == (3, 2, 1, 0, 1)
    assert evaluate.parameter_grid(spark, a=[1, 2], b=[3, 4, 5]).count() == 6
    runs = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "k string, ms long, rate double")
    assert rows(evaluate.average_reports(runs, ["k"], ["ms"], ["rate"])) == [("x", 1, 1.5)]
    assert evaluate.timed(lambda: 1, lambda _: spark.range(3), 3)["lookup_ms"] > 0


def test_lookup_of_a_stream(spark, tmp_path):
    names = [f"s{i}" for i in range(50)]
    keys, plan, got = keys_of(spark, names), recsplit.Plan(bucket_size=20, leaf=5), []
    artifact = persist(recsplit.build(keys, plan, 50), "t")
    keys.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string").parquet(str(tmp_path / "in"))
    query = lookup_stream(stream, lambda k: recsplit.lookup(k, artifact, plan, 50), lambda out, number: got.extend(r.mph for r in out.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == list(range(50))
