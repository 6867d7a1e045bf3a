"""Readers and writers of the file formats the library works with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rankfold.schema import text_schema


def read_text_table(spark: SparkSession, path: str, columns: list[str], select: list[str] | None = None) -> DataFrame:
    """CSV with header, every column text, doubled quotes inside quoted fields.

    The schema is given, not inferred, so there is no extra pass over the file and only
    the selected columns are parsed. Quoted line breaks are not expected: files stay splittable.
    """
    table = (spark.read.schema(text_schema(columns)).option("header", True).option("escape", '"')
             .option("enforceSchema", False).csv(path))
    return table.select(*select) if select else table


def read_text_table_by_header(spark: SparkSession, path: str, select: list[str] | None = None) -> DataFrame:
    """Same, with column names taken from the header line."""
    table = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    return table.select(*select) if select else table


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV report with header; doubled quotes, so that `read_text_table` reads it back."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_record(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_record(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The stored record, or None when there is none or its writing never finished (no `_SUCCESS` marker)."""
    try:
        found = spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    finished = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    return found if finished and not found.isEmpty() else None


def resume_record(spark: SparkSession, path: str, schema: T.StructType, compute: Callable[[], DataFrame]) -> DataFrame:
    """Stored record if present; otherwise compute, store and read back."""
    found = read_record(spark, path, schema)
    if found is None:
        write_record(compute(), path)
        found = spark.read.schema(schema).json(path)
    return found


def evaluate_fully(df: DataFrame) -> None:
    """Run every column of every row without keeping anything."""
    df.write.format("noop").mode("overwrite").save()


def from_local(spark: SparkSession, rows, schema) -> DataFrame:
    """Small local rows (list or pandas frame) as a DataFrame."""
    return spark.createDataFrame(rows, schema)
