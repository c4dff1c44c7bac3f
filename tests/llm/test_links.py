"""Fingerprint links of both index forms against all pairs."""

import random

import pytest

from keyloom.llm import simhash


@pytest.mark.parametrize("n", [0, simhash.FEW + 1])
@pytest.mark.parametrize("most", [1, 2, 4, 5])
def test_links_are_all_pairs(spark, n, most):
    r = random.Random(most)
    prints = set()
    for _ in range(60):
        base = r.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            own = base
            for i in r.sample(range(64), r.randint(0, 7)):
                own ^= 1 << i
            prints.add(own)
    prints |= {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    want = sorted((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= most)
    got = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), most, n).collect()
    assert sorted((x.a, x.b) for x in got) == want and len(want) > 20


@pytest.mark.parametrize("n", [0, simhash.FEW + 1])
def test_some_part_has_one_difference_at_most(n):
    r = random.Random(5)
    for most in (1, 2, 3, 4, 6):
        masks = simhash.segments(most, n)
        for _ in range(400):
            x = sum(1 << i for i in r.sample(range(64), most))
            assert min((x & m).bit_count() for m in masks) <= 1


@pytest.mark.parametrize("n", [0, simhash.FEW + 1])
def test_the_index_is_never_broadcast(spark, tmp_path, n):
    spark.range(1000).selectExpr("xxhash64(id) as fingerprint").write.parquet(f"{tmp_path}/prints")
    links = simhash.link_fingerprints(spark.read.parquet(f"{tmp_path}/prints"), 4, n)
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
