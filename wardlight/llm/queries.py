"""The registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import (best_position, language, licences, line_join, mixing, neural_lm, phrase_graph, pii, quality_lines,
                            secret_net, simhash_groups, warc_index, winnow)
from wardlight.llm.common import table


def op1_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.capture_history(table(spark, sf_dir, "pages"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_lines.line_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept")


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.line_classes(table(spark, sf_dir, "documents"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_lm.score(table(spark, sf_dir, "documents"))


def op7_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op9_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_debruijn_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(table(spark, sf_dir, "documents"))


def op12_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_net.scan(table(spark, sf_dir, "documents"))


def op13_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_crf_pii": op1_crf_pii,
    "op2_warc_merge": op2_warc_merge,
    "op3_line_quality": op3_line_quality,
    "op4_crf_language": op4_crf_language,
    "op5_line_edit_join": op5_line_edit_join,
    "op6_log_bilinear": op6_log_bilinear,
    "op7_licence_classifier": op7_licence_classifier,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_winnow_decontaminate": op9_winnow_decontaminate,
    "op10_temperature_mix": op10_temperature_mix,
    "op11_debruijn_collocations": op11_debruijn_collocations,
    "op12_secret_network": op12_secret_network,
    "op13_best_position_search": op13_best_position_search,
}
