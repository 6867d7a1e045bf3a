"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankfold.llm import alignment, ann, chat, decontaminate, jaccard, language, lines, mixing, quality, secrets, suffixtree, turns, warc
from rankfold.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.echo_pairs(table(spark, sf_dir, "conversations")), keep=("conv_id",))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score_documents(table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.as_rows(warc.resolve_revisits(warc.page_captures(table(spark, sf_dir, "pages"))))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_report(table(spark, sf_dir, "conversations"))


REGISTRY = {f.__name__: f for f in (op1_secret_scan, op2_nearest_neighbours, op3_line_dedup, op4_source_mix, op5_preference_format,
                                    op6_quality_classifier, op7_suffix_tree_scores, op8_benchmark_leaks, op9_revisit_resolution, op10_jaccard_join,
                                    op11_token_alignment, op12_language_id, op13_conversation_repair)}
SQL = {"op3_line_dedup": lines.SQL, "op4_source_mix": mixing.SQL, "op5_preference_format": chat.SQL, "op9_revisit_resolution": warc.SQL,
       "op13_conversation_repair": turns.SQL}
