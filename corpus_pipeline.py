"""From documents to a training mix: the stages of the corpus pipeline.

For every stage: columns that are not named below are carried, whatever their names and types. Rows without doc_id go in stage 2, where
also one row of each repeated doc_id stays (the largest text; null only if there is no other). A null text is one without words and without
lines; it is neither copy nor contaminated, and its size is 0. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import decontamination, line_dedup, mixing, ngram_join, quality
from tracewarden.llm.common import prepared, stored, table


def _of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose doc_id is (left_semi) or is not (left_anti) among ``ids``; the key's name is one that docs do not have."""
    key = "key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return docs.join(stored(ids.select(F.col("doc_id").alias(key))), F.col("doc_id") == F.col(key), how)


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from all of ``docs`` and the labels."""
    prepared(spark)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks that an earlier place has; n_chars follows the text."""
    prepared(spark)
    rest = line_dedup.deduplicated(docs)
    return rest.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else rest


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of its smallest doc_id; documents without words all stay."""
    prepared(spark)
    return _of(docs, ngram_join.classes(docs).filter("doc_id = component_id"), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return _of(docs, decontamination.digest(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    prepared(spark)
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", accept),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]

# The first stage fits a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages one after the other to documents, each on what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
