"""Elias-Fano queries over every user's events."""

import collections
import math

from keyloom.plans import catalogue

DIR = "/root/testdata/sf0.01"


def test_every_users_events_are_coded(spark):
    users = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/events.parquet").select("user_id", "event_id").collect():
        users[r.user_id].append(r.event_id)
    queries = catalogue.queries()
    coded = {r.g: r for r in queries["ef_encode"](spark, DIR).collect()}
    space = {r.g: r.bits for r in queries["ef_space"](spark, DIR).collect()}
    back = sorted((r.g, r.i, r.value) for r in queries["ef_roundtrip"](spark, DIR).collect())
    assert back == [(g, i, v) for g in sorted(users) for i, v in enumerate(sorted(users[g]))]
    assert len(users) > 20 and set(coded) == set(space) == set(users)
    for g, values in users.items():
        values, ratio = sorted(values), math.ceil(max(values) / len(values))
        low = 0 if ratio <= 1 else (ratio - 1).bit_length()
        highs = [0, *(v >> low for v in values)]
        assert coded[g].upper == "".join("0" * (b - a) + "1" for a, b in zip(highs, highs[1:]))
        assert coded[g].lower == "".join(f"{v & ((1 << low) - 1):0{low}b}" for v in values if low)
        assert space[g] == len(values) * low + len(values) + (values[-1] >> low)
