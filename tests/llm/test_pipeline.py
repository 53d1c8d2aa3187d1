"""The stages of the pipeline against plain Python, each on its own input; registered queries against their SQL."""

import brute
import pytest
from compare import connect, differences
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tracewarden.llm.common import stored
from tracewarden.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, frames = texts(docs), [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF)))
        if len(frames) <= 5:
            assert frames[-1].columns == docs.columns
    accepted, lines, single, clean = (texts(f) for f in frames[1:5])
    good = {i for i, r in labels.items() if r.quality == 1 and not r.toxic}
    assert len(good & set(accepted)) >= 0.97 * len(good) and accepted.items() <= before.items()
    assert lines == {i: t for i, (_, _, t) in brute.without_repeats(accepted).items()}
    assert single == {i: t for i, t in lines.items() if brute.near_components(lines)[i][1] == i}
    hit = brute.contaminated(single, items)
    assert clean == {i: t for i, t in single.items() if not hit[i][4]}
    last = frames[5].collect()
    assert {r.doc_id: r.size for r in last} == {i: len(brute.spaced(t)) for i, t in clean.items()}
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.taken) for r in last}


def test_odd_and_empty_documents(spark, odd, nothing):
    for docs in (odd, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stored(stage(spark, docs, SF))
            assert k == 4 or docs.columns == odd.columns


def test_clashing_names_and_maps(spark, odd):
    """Columns with names that the stages use, dots and maps, while ids repeat."""
    names = ["_kept", "_found", "a.b", "key", "_best", "v0", "gone"]
    docs = odd.drop("gone").select("*", *[F.lit(n).alias(n) for n in names], F.create_map(F.lit("k"), F.col("source")).alias("m"))
    docs, columns = stored(docs), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF))
        assert k == 4 or docs.columns == columns
    assert docs.count() > 0
