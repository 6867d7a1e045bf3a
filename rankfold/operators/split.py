"""Stratified train/test split, folds, fixed random order and hash samples.

Every row gets a position from the md5 of (seed, id), so the outcome depends on ids
only - not on file layout, partition count or retries. md5 spreads rows evenly over
hash buckets whatever the data looks like; positions inside a bucket come from a window
over that bucket, and bucket offsets from the table of bucket counts, whose size is
(number of buckets) x (number of classes) and does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Leading hex digits of the hash that name a bucket: 16^4 buckets.
BUCKET_DIGITS = 4


def hash_order(id_column: str, seed: int) -> Column:
    """Hex text whose order is the fixed random order of a seed."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")).cast("binary"))


def _bucketed(df: DataFrame, id_column: str, seed: int, digits: int) -> DataFrame:
    return df.withColumn("_hash", hash_order(id_column, seed)).withColumn("_bucket", F.substring("_hash", 1, digits))


def make_split(
    df: DataFrame, id_column: str = "id", label: str = "default", test_size: float = 0.2, seed: int = 42,
    n_folds: int = 3, digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Partition table `(id, split, fold, is_test, rank)`.

    In each class the first ceil(test_size * n) rows of the hash order are test rows; the
    following training rows take folds in turn; `rank` numbers all training rows from 0.
    `fold` and `rank` are -1 on test rows. One shuffle of (id, label).
    """
    rows = _bucketed(df.select(F.col(id_column).alias("id"), F.col(label).alias("_label")), "id", seed, digits)

    per_class = W.partitionBy("_label")
    cells = (
        rows.groupBy("_bucket", "_label").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(
            F.sum("_n").over(per_class.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_class_n", F.sum("_n").over(per_class))
        # 1e-9 keeps 0.2 * 15 at 3 when the product lands a hair above it.
        .withColumn("_n_test", F.ceil(F.col("_class_n") * F.lit(test_size) - F.lit(1e-9)))
        .withColumn("_train_n", F.greatest(F.col("_before") + F.col("_n") - F.col("_n_test"), F.lit(0))
                    - F.greatest(F.col("_before") - F.col("_n_test"), F.lit(0)))
    )
    # All buckets in one window: 16^digits rows, a constant.
    train_before = cells.groupBy("_bucket").agg(F.sum("_train_n").alias("_train_n")).select(
        "_bucket",
        F.coalesce(F.sum("_train_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_train_before"))
    cells = cells.select("_bucket", "_label", "_before", "_n_test").join(train_before, "_bucket")

    # Both windows below need the rows of a bucket together, so they share this exchange.
    placed = rows.repartition("_bucket")
    in_class = W.partitionBy("_bucket", "_label").orderBy("_hash", "id")
    in_bucket = W.partitionBy("_bucket").orderBy("_hash", "id").rowsBetween(W.unboundedPreceding, 0)
    numbered = (
        placed.join(F.broadcast(cells), ["_bucket", "_label"])
        .withColumn("_position", F.col("_before") + F.row_number().over(in_class) - 1)
        .withColumn("is_test", F.col("_position") < F.col("_n_test"))
        .withColumn("_rank", F.col("_train_before") + F.sum(F.when(F.col("is_test"), 0).otherwise(1)).over(in_bucket) - 1)
    )
    nothing = F.lit(-1).cast("long")
    return numbered.select(
        "id",
        F.when(F.col("is_test"), "test").otherwise("train").alias("split"),
        F.when(F.col("is_test"), nothing).otherwise(F.pmod(F.col("_position") - F.col("_n_test"), F.lit(n_folds)))
        .cast("long").alias("fold"),
        "is_test",
        F.when(F.col("is_test"), nothing).otherwise(F.col("_rank")).cast("long").alias("rank"),
    )


def hash_positions(df: DataFrame, id_column: str, seed: int, name: str = "position",
                   digits: int = BUCKET_DIGITS) -> DataFrame:
    """Number all rows 0..n-1 in the fixed random order of a seed."""
    rows = _bucketed(df, id_column, seed, digits)
    offsets = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket",
        F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    order = W.partitionBy("_bucket").orderBy("_hash", id_column)
    return (
        rows.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_before") + F.row_number().over(order) - 1).cast("long"))
        .drop("_bucket", "_hash", "_before")
    )


def hash_sample(df: DataFrame, id_column: str, n: int, seed: int = 42, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Exactly min(n, rows) random rows, the same ones on every run.

    Buckets that lie wholly behind the n-th row are dropped before the rows are shuffled.
    """
    rows = _bucketed(df, id_column, seed, digits)
    needed = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket",
        F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before")).filter(F.col("_before") < n)
    order = W.partitionBy("_bucket").orderBy("_hash", id_column)
    return (
        rows.join(F.broadcast(needed), "_bucket")
        .withColumn("_position", F.col("_before") + F.row_number().over(order) - 1)
        .filter(F.col("_position") < n)
        .drop("_bucket", "_hash", "_before", "_position")
    )


def fraction_sample(df: DataFrame, id_column: str, fraction: float, n: int | None = None, seed: int = 42) -> DataFrame:
    """Rows whose hash falls in the first `fraction` of the hash space, at most `n` of them; all rows from 1 on."""
    kept = df if fraction >= 1 else df.filter(F.substring(hash_order(id_column, seed), 1, 8) < f"{int(fraction * 16**8):08x}")
    return kept if n is None else hash_sample(kept, id_column, n, seed)


def prefix_subset(split: DataFrame, n: int) -> DataFrame:
    """The first n training rows of the fixed order; subsets of growing n are nested."""
    return split.filter((F.col("rank") >= 0) & (F.col("rank") < n))


def split_summary(split_with_label: DataFrame, by: list[str], label: str = "default") -> DataFrame:
    """Rows, share of all rows and positive rate of each part.

    The parts are splits and folds, so the total over them is a handful of rows.
    """
    parts = split_with_label.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(label).alias("positive_rate"))
    total = split_with_label.agg(F.count("*").alias("n")).scalar()
    return parts.select(*by, "n_rows", (100.0 * F.col("n_rows") / total).alias("pct"), "positive_rate")


def table_difference(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """One row `(missing, extra)`: rows of either table that the other lacks."""
    columns = stored.columns
    missing = stored.exceptAll(recomputed.select(*columns)).agg(F.count("*").alias("n")).scalar()
    extra = recomputed.select(*columns).exceptAll(stored).agg(F.count("*").alias("n")).scalar()
    return stored.sparkSession.range(1).select(missing.alias("missing"), extra.alias("extra"))


def id_overlap(a: DataFrame, b: DataFrame, id_column: str = "id") -> DataFrame:
    """Sizes of two id sets and of their intersection, from one tagged aggregation."""
    tagged = (a.select(id_column).distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
              .unionByName(b.select(id_column).distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))))
    per_id = tagged.groupBy(id_column).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per_id.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n_b"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_common"),
    )
