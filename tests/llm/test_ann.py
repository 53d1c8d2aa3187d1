"""Recall and exactness of the forest search against all inner products."""

import math
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tracewarden.llm import ann_forest

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, tree int, members int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", 1, 2) for i, e in rows], SCHEMA)


def exact(rows, k=20):
    x = np.array([e for _, e in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for n in np.flatnonzero(ids % 20 == 0):
        s = (x * x[n]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
        out[int(ids[n])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hits = 0
    assert set(found) == {q for q, w in want.items() if w}
    for q, rows in found.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(want[q])
        assert all(a.score > b.score or a.score == b.score and a.vec_id < b.vec_id for a, b in zip(rows, rows[1:]))
        hits += len({r.vec_id for r in rows} & {i for i, _ in want[q]})
    return hits / max(1, sum(map(len, want.values())))


def test_recall_on_the_test_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in rows.collect()])
    assert recall(ann_forest.digest(rows).collect(), want) >= 0.9


def test_clusters_blocks_and_copies(spark):
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    rows = [(i, [3 * c + draw.gauss(0, 0.3) for c in centres[i % 15]]) for i in range(900)]
    rows += [(i, [0.5] * 12) for i in range(900, 1300)]  # a third are equal
    want = exact(rows)
    got = ann_forest.search(frame(spark, rows), F.col("vec_id") % 20 == 0, fit=500, block=50, reach=2.0).collect()
    assert recall(got, want) >= 0.9
    equal = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in (900, 1280)}
    assert all(len(v) == 20 and q not in v for q, v in equal.items())


def test_whole_reach_is_exact(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice((-1.0, 0.0, 1.0)) for _ in range(4)] + [1.0]) for i in range(300)]  # many ties and copies
    want = exact(rows)
    got = ann_forest.search(frame(spark, rows), F.col("vec_id") % 20 == 0, reach=99.0).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == {
        (q, k + 1): hit for q, w in want.items() for k, hit in enumerate(w)}


def test_odd_vectors(spark):
    good = [(0, [1.0, 2.0]), (20, [-1.0, 0.5]), (3, [1.0, 2.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [math.inf, 1.0]), (120, [1.0, None]), (140, []), (160, [1.0]), (None, [1.0, 2.0])]
    got = ann_forest.digest(frame(spark, good + bad + good)).collect()
    assert recall(got, exact(good)) == 1.0
    assert {r.query_id for r in got} == {0, 20}


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 1.0])], [(1, None)]])
def test_nothing(spark, rows):
    assert ann_forest.digest(frame(spark, rows)).count() == 0
