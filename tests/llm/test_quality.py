"""Weak labels and the scorer: planted labellers, held-out labels, odd rows."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tracewarden.llm import quality


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    votes = []
    for right, speaks in ((0.95, 0.9), (0.8, 0.9), (0.7, 0.5), (0.55, 0.9)):
        vote = np.where(rng.random(len(truth)) < right, truth, ~truth).astype(int)
        votes.append(np.where(rng.random(len(truth)) < speaks, vote, -1))
    patterns, back, counts = np.unique(np.stack(votes, 1), axis=0, return_inverse=True, return_counts=True)
    found = quality.estimate(patterns, counts)[back] > 0.5
    majority = np.array([(p == 1).sum() > (p == 0).sum() for p in patterns])[back]
    assert (found == truth).mean() > max(0.93, (majority == truth).mean())


def test_held_out_labels(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.digest(docs, labels.filter("doc_id % 4 != 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id")
    rate = scored.groupBy("quality", "toxic").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()
    rate = {(r.quality, r.toxic): r.r for r in rate}
    assert rate[0, 0] > 0.95 and rate[1, 1] > 0.8 and rate[1, 0] < 0.02


def test_odd_rows(spark, odd, nothing, kept_texts):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels = spark.createDataFrame([(10, 1, 0), (10, None, 1), (None, 0, 0), (48, 0, None), (999, 0, 1)], none.schema)
    for given in (none, labels):
        out = quality.digest(odd, given).collect()
        assert {r.doc_id for r in out} == set(kept_texts)
        assert all(0 <= r.p_low <= 1 and 0 <= r.p_toxic <= 1 for r in out)
    kept = quality.accepted(odd, quality.train(odd))
    assert kept.columns == odd.columns
    assert quality.digest(nothing, none).count() == 0
    assert quality.accepted(nothing, quality.train(nothing, labels)).count() == 0


def test_repeated_words_do_not_outvote_whole_texts(spark):
    rows = [(i, "Plain words stand here in good order. They say this and that about it.") for i in range(50)]
    rows += [(50 + i, "LOUD!! WORDS!! BUY!! NOW!! BEST!! PRICE!! " * 20) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.rejected for r in quality.digest(docs, docs.selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic")).collect()}
    assert not any(out[i] for i in range(50)) and all(out[i] for i in range(50, 100))
