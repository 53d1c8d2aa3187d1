"""One registered query per operator of this folder, over whole tables with production parameters."""

from tracewarden.llm import (
    ann_forest, decontamination, divergence, hard_negatives, language_id, licences, line_dedup, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup,
)
from tracewarden.llm.common import table
from tracewarden.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op3_language_id": lambda spark, folder: language_id.digest(table(spark, folder, "pages"), table(spark, folder, "documents")),
    "op4_license_scan": lambda spark, folder: licences.digest(spark, folder),
    "op1_ann_forest": lambda spark, folder: ann_forest.digest(table(spark, folder, "embeddings")),
    "op9_quality_classifier": lambda spark, folder: quality.digest(
        table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op8_source_mixing": lambda spark, folder: mixing.digest(table(spark, folder, "documents")),
    "op2_line_dedup": lambda spark, folder: line_dedup.digest(table(spark, folder, "documents")),
    "op5_benchmark_decontamination": lambda spark, folder: decontamination.digest(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")),
    "op6_substring_dedup": lambda spark, folder: substring_dedup.digest(table(spark, folder, "documents")),
    "op7_ngram_jaccard_join": lambda spark, folder: ngram_join.digest(table(spark, folder, "documents")),
    "op10_suffix_array_dedup": lambda spark, folder: suffix_dedup.digest(table(spark, folder, "documents")),
    "op13_packing": lambda spark, folder: packing.digest(table(spark, folder, "documents")),
    "op12_source_divergence": lambda spark, folder: divergence.digest(table(spark, folder, "documents")),
    "op11_hard_negatives": lambda spark, folder: hard_negatives.digest(table(spark, folder, "embeddings")),
}
