"""What the n-gram join compares and leaves on disk: usual lines come last in a set, and finished steps keep no shuffle files."""

import time
from pathlib import Path

import brute
import numpy as np
import pytest
from conftest import passage

from tracewarden.llm import common, ngram_join

LINE = passage(900, 16)


def texts_with_a_line():
    """Unrelated texts under one line, near copies of some of them, and texts that are little more than the line."""
    rows = [(i, " ".join(LINE) + "\n" + " ".join(passage(1000 + i, 25 + i % 40))) for i in range(400)]
    for i in range(0, 400, 20):
        words = rows[i][1].split()
        words[-1] = f"w{i}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join([*LINE, "end", f"w{i % 7}"][: 16 + i % 3])) for i in range(30)]
    return rows


def test_a_usual_line_makes_no_group(spark, monkeypatch):
    rows = texts_with_a_line()
    crossed, met = ngram_join.crossed, []
    monkeypatch.setattr(ngram_join, "crossed", lambda held, *a: met.append(held.count()) or crossed(held, *a))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()}
    assert got == brute.near_components(dict(rows))
    assert sum(got[i][1] != i for i, _ in rows) >= 40
    assert met[0] < 40  # not the 400 that share the line


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_members_finds_the_same(odd, kept_texts, monkeypatch, seed):
    drawn = np.random.default_rng(seed).integers(0, 4, ngram_join.SLOTS).astype(np.uint8)
    monkeypatch.setattr(ngram_join, "levels", lambda counted: drawn, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(odd).collect()}
    assert got == brute.near_components(kept_texts)


def test_levels_count_all_tasks(spark):
    rows = texts_with_a_line()[:400]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    slots = lambda text: ngram_join.slots(ngram_join.whole_sets(ngram_join.pa.array([text]), 5)[1])
    one, many = (ngram_join.levels(ngram_join.signatures(docs.repartition(n)).filter("doc_id IS NULL")) for n in (1, 7))
    assert (one == many).all()
    usual = slots(" ".join(LINE))
    assert len(usual) == 12 and (many[usual] == 5).all()  # 400 sets are 25 units of 16
    assert (many > 0).sum() < 40  # with runs of five that go from the line into some texts
    assert not ngram_join.levels(ngram_join.signatures(docs.limit(0)).filter("doc_id IS NULL")).any()


def test_stored_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*")}
    before = files()
    table = common.stored(spark.range(100_000).selectExpr("id % 1000 AS k").groupBy("k").count())
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 1000 and spark.conf.get(common.CLEANUP) == "false"
