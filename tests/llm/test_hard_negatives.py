"""Hard negatives against plain Python, and what the bounds promise."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import hard_negatives as h

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, members int, r double, norm string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, la, "x", 1, 2.0, "n") for i, la, e in rows], SCHEMA)


def expected(rows, every=50, positives=5, negatives=3):
    """Rows (vec_id, label, vector) without copies of ids."""
    length = max(({len(e) for _, _, e in rows if e}), key=lambda n: (sum(len(e or ()) == n for *_, e in rows), -n), default=0)
    use = {}
    for i, la, e in rows:
        if i is None or la is None or not e or len(e) != length or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        la = (la + 1) % 10 if i % 7 == 0 else la
        use[i] = min(use.get(i, (str(la), q)), (str(la), q))
    out = set()
    for a, (la, q) in use.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in use.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if use[i][0] == la][:positives]:
            hard = [i for i in order if use[i][0] != la and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out |= {(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(hard)}
    return out


def found(df):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clusters(n, size=8, copies=0, seed=2):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = centres[draw.randrange(12)]
        rows.append((i, draw.randrange(10), [x + draw.gauss(0, 0.4) for x in c]))
    rows += [(n + i, i % 2, centres[0]) for i in range(copies)]
    return rows


def test_against_all_scores(spark):
    rows = clusters(700, copies=350)
    got = found(h.digest(frame(spark, rows)))
    assert got == expected(rows) and len(got) > 50


def test_blocks(spark):
    rows = clusters(600, size=3, copies=100, seed=9)
    got = found(h.mine(frame(spark, rows).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))),
                       F.col("vec_id") % 50 == 0, references=3, block=37, asked=2))
    assert got == expected(rows)


def test_ties_and_small_numbers(spark):
    draw = random.Random(4)
    rows = [(i, draw.randrange(2), [draw.choice((0.0, 0.25, -0.25, 0.5)) for _ in range(3)]) for i in range(300)]  # many ties, zero vectors
    assert found(h.digest(frame(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    rows = clusters(120, size=4)
    rows += [(200, None, [1.0] * 4), (250, 1, None), (300, 1, [1.0, None, 1.0, 1.0]), (350, 1, [math.nan, 1.0, 1.0, 1.0]), (400, 1, [math.inf] * 4),
             (450, 1, []), (500, 1, [1.0]), (None, 1, [1.0] * 4), (550, 1, [0.0] * 4), (0, 3, [9.0] * 4), (0, 3, [9.0] * 4)]
    assert found(h.digest(frame(spark, rows))) == expected(rows)
    huge = [*rows, (600, 1, [1e30] * 4)]  # its scores fit no long
    assert found(h.digest(frame(spark, huge))) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(50, 1, [1.0, 2.0])], [(50, None, None)], [(51, 1, [1.0])]])
def test_nothing(spark, rows):
    assert h.digest(frame(spark, rows)).count() == 0


@pytest.mark.parametrize("scale", [1, 300, 10_000_000])
def test_bounds_hold(scale):
    rng = np.random.default_rng(5)
    q = np.r_[rng.integers(-scale, scale + 1, (300, 6)), np.zeros((1, 6), np.int64), np.full((2, 6), scale), np.full((1, 6), -scale)]
    axes = h.directions(q, 8)
    norms, angles = h.angles_to(q, axes)
    for k in range(len(q)):
        low, high = h.score_bounds(norms, angles, norms[k], angles[k])
        score = h.whole_scores(q, q[k], norms[k] * norms.max())
        assert (score == [sum(int(a) * int(b) for a, b in zip(x, q[k])) for x in q]).all()
        assert (low <= score).all() and (score <= high).all()


def test_only_overlapping_windows_are_scored(monkeypatch):
    scored = []
    monkeypatch.setattr(h, "whole_scores", lambda q, own, largest, f=h.whole_scores: (scored.append(len(q)), f(q, own, largest))[1])
    rng = np.random.default_rng(6)
    q = (np.repeat(rng.normal(size=(20, 16)), 100, 0) * 1000 + rng.normal(size=(2000, 16)) * 20).astype(np.int64)
    norms, angles = h.angles_to(q, h.directions(q, 16))
    ids = np.arange(len(q))
    top = int((q @ q[0]).max())
    exact = q @ q[0]
    (names, scores), = h.within(ids, q, norms, angles, q[0], norms[0], angles[0], [(top // 2, top * 95 // 100)], 3)
    fits = [i for i in sorted(ids, key=lambda i: (-exact[i], i)) if top // 2 <= exact[i] <= top * 95 // 100][:3]
    assert names.tolist() == fits and scores.tolist() == exact[fits].tolist()
    assert sum(scored) < 700
