"""Apportionment, shards and caps."""

from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import mixing


def water(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return out
        per = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if per * weight[s] >= 3 * sizes[s] and sizes[s] * 3 <= per * weight[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else per * weight[s] for s in order}
        full |= over
        out = {s: float(3 * sizes[s]) if s in full else per * weight[s] for s in order}
        assert left >= 0


@pytest.mark.parametrize("block,shard", [(16, 2_000_000), (1, 100), (7, 50)])
def test_mix(odd, kept_texts, block, shard):
    rows = mixing.mixed(odd, block, shard).collect()
    assert {r.doc_id for r in rows} == set(kept_texts)
    sizes, taken, shards = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in rows:
        assert r.size == len(brute.spaced(kept_texts[r.doc_id])) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        shards[r.source].add(r.shard)
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block * (len(shards[s]) + 1)
        assert taken[s] <= 3 * sizes[s]
    again = mixing.mixed(odd.repartition(5), block, shard).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


@pytest.mark.parametrize("house", [0, 1, 7, 100, 1000])
def test_seats_are_the_highest_quotients(spark, house):
    votes = {0: 50, 1: 50, 2: 0, 3: 7, 4: 1000, 5: 3, 6: 50, **{k: 11 for k in range(10, 40)}}
    party = spark.createDataFrame([("g", k, v) for k, v in votes.items()], "g string, k int, v bigint")
    got = {r.k: r.quota for r in mixing.seats(party, ["g"], "v", F.lit(house), F.lit(sum(votes.values())), "k").collect()}
    best = sorted(((-v / (2 * j + 1), k) for k, v in votes.items() if v for j in range(house)))[:house]
    want = {k: sum(1 for _, x in best if x == k) for k in votes}
    assert got == want


def test_nothing(nothing):
    assert mixing.mixed(nothing).count() == 0
