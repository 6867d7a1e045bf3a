"""Corpus pipeline: documents pass the stages in order, each written as Parquet and read again as the next one's input.

A document that the classifier rejects goes; repeated and nearly repeated lines go; one document of each group of similar
documents stays; documents that hold a benchmark item go; the rest is mixed by source. All stages but the last return the
columns of `documents`; `n_chars` follows the text where lines were cut. The last returns a row for every copy.

Nulls: a null text counts as empty where it is scored, and passes the other stages; a null id passes the stages that compare
documents. Extra columns are carried along. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankfold.llm import decontaminate, jaccard, lines, mixing, quality
from rankfold.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold. The model learns from whole `documents` and `labels`."""
    model = quality.CompressionClassifier.fit(table(spark, sf_dir, "documents"), quality.training_labels(table(spark, sf_dir, "labels")))
    return model.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that had lines to compare and keeps nothing goes."""
    cut = lines.dedup_lines(docs, short_copies=True)
    count = F.when(F.col("_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.filter(~((F.col("_removed") > 0) & (F.col("text") == ""))).withColumn("n_chars", count).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.emit(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The classifier's dictionaries can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored in the shared folder, which cuts the lineage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
