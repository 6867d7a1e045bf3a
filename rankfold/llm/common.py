"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankfold.session import materialize  # noqa: F401

#: Narrow rows of at most this number are broadcast rather than shuffled.
TOLD_ROWS = 100_000

SPACES = "\x20\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def told(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What a join does with `rows` and others of their number: a broadcast of up to TOLD_ROWS, nothing with more."""
    return F.broadcast if rows.count() <= TOLD_ROWS else lambda df: df


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def unit_hash(seed: str, column: str) -> Column:
    """Uniform number in [0, 1) from md5 of seed and value: 52 bits, the same on every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def unit_hash_sql(seed: str, column: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || coalesce(CAST({column} AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(16**13)!r}"


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for the jobs run inside; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
