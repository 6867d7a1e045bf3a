"""Association of columns with a binary label and with each other."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankfold.functions.scalars import ratio
from rankfold.functions.tails import chi2_p, normal_p, t_p
from rankfold.functions.text import number, year_month
from rankfold.operators.metrics import score_distribution
from rankfold.operators.ordering import (PLAIN_LIMIT, RANGE_ROWS, Distribution, count_distinct_pairs, distribution, lookup,
                                         running_sums, with_group_columns)


def crosstab(df: DataFrame, a: str, b: str, levels: list, normalize: bool = False) -> DataFrame:
    """Counts of `a` by the given levels of `b`; `normalize` gives row shares instead."""
    table = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).pivot(b, levels).count().fillna(0)
    if not normalize:
        return table
    total = sum((F.col(f"`{v}`") for v in levels[1:]), F.col(f"`{levels[0]}`"))
    return table.select(a, *[ratio(F.col(f"`{v}`"), total).alias(str(v)) for v in levels])


def pair_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """`(var_a, var_b, a, b, n)` of all column pairs in one pass; rows with a null side drop out."""
    cells = F.array(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(a).cast("string").alias("a"),
                               F.col(b).cast("string").alias("b")) for a, b in pairs])
    return (df.select(F.inline(cells)).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
            .groupBy("var_a", "var_b", "a", "b").agg(F.count("*").cast("double").alias("n")))


def chi2_from_counts(counts: DataFrame) -> DataFrame:
    """Chi-square of independence without continuity correction, one row per variable pair.

    Only occupied cells are needed: chi2 = n (sum o^2 / (row x column) - 1).
    """
    pair = ["var_a", "var_b"]
    # The cells are few next to the rows they count; sums of rows and columns are windows over them.
    row_n = F.sum("n").over(W.partitionBy(*pair, "a"))
    col_n = F.sum("n").over(W.partitionBy(*pair, "b"))
    cells = counts.withColumns({"row_n": row_n, "col_n": col_n})
    return cells.groupBy(*pair).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") / (F.col("row_n") * F.col("col_n"))).alias("share"),
        F.count_distinct("a").alias("levels_a"), F.count_distinct("b").alias("levels_b")).select(
        *pair, F.col("total").cast("long").alias("n"), "levels_a", "levels_b",
        (F.col("total") * (F.col("share") - 1)).alias("chi2"),
        ((F.col("levels_a") - 1) * (F.col("levels_b") - 1)).alias("dof"))


def corrected_v(chi2: Column, total: Column, levels_a: Column, levels_b: Column) -> Column:
    """Cramer's V after Bergsma (2013): what independent variables would show on average is taken off.

    A table with one level on a side has no association.
    """
    spare = total.cast("double") - 1

    def freedom(levels: Column) -> Column:
        return (levels - 1) * (1 - ratio(levels - 1, spare))

    by_chance = ratio((levels_a - 1) * (levels_b - 1), spare)
    excess = ratio(chi2, total.cast("double")) - by_chance
    most = F.least(freedom(levels_a), freedom(levels_b))
    return F.when((excess > 0) & (most > 0), F.sqrt(excess / most)).otherwise(F.lit(0.0))


def categorical_association(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """chi2, degrees of freedom, p and Cramer's V of each column against the label."""
    table = chi2_from_counts(pair_counts(df, [(c, label) for c in columns]))
    return table.select(
        F.col("var_a").alias("variable"), F.col("levels_a").alias("levels"), "chi2", "dof",
        chi2_p("chi2", "dof").alias("p_value"),
        corrected_v(F.col("chi2"), F.col("n"), F.col("levels_a"), F.col("levels_b")).alias("cramers_v"))


def cramers_v_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(var_a, var_b, cramers_v)` for all ordered pairs, from all rows; 1 on the diagonal."""
    table = chi2_from_counts(pair_counts(df, list(combinations(columns, 2)))).select(
        "var_a", "var_b",
        corrected_v(F.col("chi2"), F.col("n"), F.col("levels_a"), F.col("levels_b")).alias("cramers_v"))
    mirrored = table.select(F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), "cramers_v")
    diagonal = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("var_a")).select(
        "var_a", F.col("var_a").alias("var_b"), F.lit(1.0).alias("cramers_v"))
    return table.unionByName(mirrored).unionByName(diagonal)


def long_numeric(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """`(variable, value[, y])` without nulls; NaN counts as missing."""
    keep = [F.col(label).alias("y")] if label else []
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def class_moments(long: DataFrame) -> DataFrame:
    """Count, mean and sample variance of each variable in each class, side by side."""
    def of(y: int, suffix: str) -> list[Column]:
        value = F.when(F.col("y") == y, F.col("value"))
        return [F.count(value).cast("double").alias(f"n{suffix}"), F.avg(value).alias(f"mean{suffix}"),
                F.var_samp(value).alias(f"var{suffix}")]

    return long.groupBy("variable").agg(*of(1, "1"), *of(0, "0"),
                                        F.corr(F.col("y").cast("double"), "value").alias("point_biserial"))


def with_welch_and_d(moments: DataFrame) -> DataFrame:
    """Welch's t with its degrees of freedom, and Cohen's d with pooled variance."""
    a, b = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    diff = F.col("mean1") - F.col("mean0")
    pooled = F.sqrt(ratio((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0"),
                          F.col("n1") + F.col("n0") - 2))
    return moments.withColumns({
        "diff": diff, "cohens_d": ratio(diff, pooled), "t": ratio(diff, F.sqrt(a + b)),
        "t_dof": ratio((a + b) ** 2, ratio(a ** 2, F.col("n1") - 1) + ratio(b ** 2, F.col("n0") - 1)),
    })


def mann_whitney(long: DataFrame) -> DataFrame:
    """U of the positive class and its asymptotic z, corrected for ties and continuity."""
    table = score_distribution(long, ["variable"], "value").table
    n1, n0 = F.first("pos_total").cast("double"), F.first("neg_total").cast("double")
    t = (F.col("pos") + F.col("neg")).cast("double")
    sums = table.groupBy("variable").agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"), n1.alias("_n1"), n0.alias("_n0"))
    n = F.col("_n1") + F.col("_n0")
    product = F.col("_n1") * F.col("_n0")
    sigma = F.sqrt(product / 12 * ((n + 1) - ratio(F.col("_ties"), n * (n - 1))))
    larger = F.greatest(F.col("u"), product - F.col("u"))
    return sums.select("variable", "u", ratio(larger - product / 2 - 0.5, sigma).alias("u_z"))


def numeric_association(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Means, difference, effect sizes, Welch and Mann-Whitney tests of each column by class."""
    long = long_numeric(df, columns, label)
    table = with_welch_and_d(class_moments(long)).join(mann_whitney(long), "variable")
    return table.select(
        "variable", "mean1", "mean0", "diff", "cohens_d", "point_biserial", "t", "t_dof", t_p("t", "t_dof").alias("p_welch"),
        # One-sided tail of the larger U, doubled: |z| would also double a tail below zero.
        "u", "u_z", F.when(F.col("u_z") < 0, F.lit(1.0)).otherwise(normal_p("u_z")).alias("p_mann_whitney"))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(var_a, var_b, r)` for a < b in column order, each over the rows where both are present."""
    rows = F.array(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                              F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
                     for a, b in combinations(columns, 2)])
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Square correlation matrix, one row per variable."""
    pairs = pearson_pairs(df, columns)
    mirrored = pairs.select(F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), "r")
    diagonal = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("var_a")).select(
        "var_a", F.col("var_a").alias("var_b"), F.lit(1.0).alias("r"))
    return pairs.unionByName(mirrored).unionByName(diagonal).groupBy(F.col("var_a").alias("variable")).pivot(
        "var_b", columns).agg(F.first("r"))


def high_correlation(df: DataFrame, columns: list[str], above: float = 0.7) -> DataFrame:
    """Pairs with |r| above the limit, strongest first."""
    return pearson_pairs(df, columns).filter(F.abs("r") > above).orderBy(F.abs("r").desc(), "var_a", "var_b")


def redundancy(model: DataFrame, extra: DataFrame, pairs: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """Correlation of model columns with columns kept outside the model, joined by key."""
    inside = [c for c in dict.fromkeys(a for a, _ in pairs)]
    joined = model.select(key, *inside).join(extra, key)
    rows = F.array(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                              F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs])
    return joined.agg(rows.alias("_rows")).select(F.inline("_rows"))


def ordinal_code(df: DataFrame, column: str, name: str, plain_limit: int = PLAIN_LIMIT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Position of each level in sorted order from 0; a null level gets -1.

    Levels are ordered, not rows, by as many ranges as they need; levels that hold many rows are
    broadcast back to them.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_level")).agg(F.count("*").alias("n"))
    distinct = count_distinct_pairs(df, [column])
    coded = running_sums(counts.withColumn("_one", F.lit(1)), [], "_level", ["_one"], distinct, plain_limit, range_rows).withColumn(name, F.col("_one_below"))
    total = df.agg(F.count("*").alias("n")).scalar()
    table = coded.select("_level", F.col(name).cast("long").alias(name), "n").withColumn("n_total", total)
    found = Distribution(table, (), "", ("n",), distinct)
    known = lookup(df.filter(F.col(column).isNotNull()), found, {column: "_level"}, [name])
    unknown = df.filter(F.col(column).isNull()).withColumn(name, F.lit(-1).cast("long"))
    return known.unionByName(unknown)


def leakage_audit(df: DataFrame, columns: list[str], label: str, date_suffix: str = "_d") -> DataFrame:
    """AUC of each raw text column alone against the label, as max(a, 1 - a).

    Columns ending in `date_suffix` are read as `Mon-YYYY`; nulls become -1.
    """
    value = [year_month(c) if c.endswith(date_suffix) else number(c) for c in columns]
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(v, F.lit(-1.0)).alias("value"))
                      for c, v in zip(columns, value)])
    long = df.select(F.col(label).alias("y"), F.inline(cells))
    found = distribution(long, ["variable"], "value", {"pos": F.col("y").cast("long"), "neg": 1 - F.col("y").cast("long")})
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0))
    one = ratio(wins, F.first("pos_total").cast("double") * F.first("neg_total"))
    return found.table.groupBy("variable").agg(one.alias("_auc")).select(
        "variable", F.greatest(F.col("_auc"), 1 - F.col("_auc")).alias("auc"))
