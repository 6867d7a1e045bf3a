"""Profiles of whole tables: nulls, distributions, levels, rates by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankfold.functions.scalars import log1p_nonnegative, ratio
from rankfold.functions.tails import chi2_p
from rankfold.operators.association import chi2_from_counts, long_numeric
from rankfold.operators.ordering import exact_quantiles, with_group_columns
from rankfold.sources.files import write_record


def frequency_table(df: DataFrame, columns: list[str], rare_below: float = 1.0) -> DataFrame:
    """Every level of every column with count, percent of all rows and a rare flag; null is a level."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("column", "level").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    pct = 100.0 * F.col("n") / total
    return counts.select("column", "level", "n", pct.alias("pct"), (pct < rare_below).alias("rare"))


def rate_by_level(df: DataFrame, column: str, label: str, min_rows: int = 500, top: int | None = 15) -> DataFrame:
    """Positive rate and size per level, large levels only, highest rate first."""
    table = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level"))
             .agg(F.avg(label).alias("rate"), F.count("*").alias("n_rows"))
             .filter(F.col("n_rows") >= min_rows).orderBy(F.desc("rate"), "level"))
    return table if top is None else table.limit(top)


def head_and_tail(table: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """First and last k rows of a ranked table, largest first."""
    head = table.orderBy(F.desc(by), tie).limit(k).withColumn("end", F.lit("head"))
    tail = table.orderBy(F.col(by), F.desc(tie)).limit(k).withColumn("end", F.lit("tail"))
    return head.unionByName(tail)


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and percent of every column in one pass, most nulls first."""
    columns = columns or df.columns
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"),
                              F.count("*").alias("n_rows")) for c in columns])
    return (df.agg(rows.alias("_rows")).select(F.inline("_rows"))
            .select("column", "nulls", (100.0 * ratio("nulls", "n_rows")).alias("pct"))
            .orderBy(F.desc("pct"), "column"))


def column_group(name: Column | str = "column") -> Column:
    """Group of a column by its name."""
    c = F.col(name) if isinstance(name, str) else name
    return (F.when(c.contains("hardship"), "hardship").when(c.contains("settlement"), "settlement")
            .when(c.contains("joint") | c.startswith("sec_app"), "joint").otherwise("other"))


def null_by_period(df: DataFrame, columns: list[str], early: Column, late: Column) -> DataFrame:
    """Null percent of each column overall and within two periods."""
    def pct(c: str, when: Column | None) -> Column:
        missing = F.col(c).isNull().cast("double")
        return 100.0 * F.avg(missing if when is None else F.when(when, missing))

    rows = F.array(*[F.struct(F.lit(c).alias("column"), pct(c, None).alias("pct"), pct(c, early).alias("pct_early"),
                              pct(c, late).alias("pct_late")) for c in columns])
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def null_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Null percent of each column within each group value."""
    return df.groupBy(group).agg(*[(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns])


def missing_vs_label(df: DataFrame, columns: list[str], label: str, min_rows: int = 10) -> DataFrame:
    """Does missingness go with the label? Rates, difference, chi2 and p; blank below `min_rows` nulls."""
    cells = F.array(*[F.struct(F.lit(c).alias("var_a"), F.col(c).isNull().cast("string").alias("a")) for c in columns])
    counts = (df.select(F.col(label).alias("_y"), F.inline(cells))
              .select("var_a", F.lit("label").alias("var_b"), "a", F.col("_y").cast("string").alias("b"), "_y")
              .groupBy("var_a", "var_b", "a", "b").agg(F.count("*").cast("double").alias("n"), F.sum("_y").alias("pos")))
    missing = F.col("a") == "true"
    rates = counts.groupBy("var_a").agg(
        F.sum(F.when(missing, F.col("n")).otherwise(0.0)).cast("long").alias("n_missing"),
        ratio(F.sum(F.when(missing, F.col("pos"))), F.sum(F.when(missing, F.col("n")))).alias("_rate_missing"),
        ratio(F.sum(F.when(~missing, F.col("pos"))), F.sum(F.when(~missing, F.col("n")))).alias("rate_present"))
    tests = chi2_from_counts(counts.drop("pos")).select("var_a", "chi2", "dof")
    enough = F.col("n_missing") >= min_rows
    return rates.join(tests, "var_a").filter(F.col("n_missing") > 0).select(
        F.col("var_a").alias("column"), "n_missing", F.when(enough, F.col("_rate_missing")).alias("rate_missing"), "rate_present",
        F.when(enough, F.col("_rate_missing") - F.col("rate_present")).alias("diff"),
        F.when(enough, F.col("chi2")).alias("chi2"), F.when(enough, chi2_p("chi2", "dof")).alias("p_value"))


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments of every column with values, from one aggregation over the wide rows; its one row is then turned.

    Skewness and excess kurtosis carry the small-sample adjustment. NaN counts as missing.
    """
    parts = []
    for c in columns:
        v = _present(c)
        parts.append(F.struct(
            F.lit(c).alias("variable"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.stddev_samp(v).alias("sd"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")))
    n, spread = F.col("n").cast("double"), F.col("sd") > 0
    return df.agg(F.array(*parts).alias("_rows")).select(F.inline("_rows")).filter("n > 0").select(
        "variable", "n", "mean", "min", "max", "sd",
        F.when((n > 2) & spread, ratio(F.col("g1") * F.sqrt(n * (n - 1)), n - 2)).alias("skew"),
        F.when((n > 3) & spread, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"))


def _present(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sd, min, quartiles, max of every numeric column."""
    quartiles = _quartiles(exact_quantiles(long_numeric(df, columns), ["variable"], "value", [0.25, 0.5, 0.75]))
    return with_group_columns(_moments(df, columns), quartiles, ["variable"]).select(
        "variable", "n", "mean", "sd", "min", "p25", "median", "p75", "max")


def _quartiles(quantiles: DataFrame) -> DataFrame:
    at = {0.25: "p25", 0.5: "median", 0.75: "p75"}
    return quantiles.groupBy("variable").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for p, name in at.items()])


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, moments, exact quartiles, 1.5 IQR fences and outliers of every column."""
    total = df.agg(F.count("*").alias("n")).scalar()
    moments = _moments(df, columns)
    quartiles = _quartiles(exact_quantiles(long_numeric(df, columns), ["variable"], "value", [0.25, 0.5, 0.75]))
    rows = quartiles.withColumn("iqr", F.col("p75") - F.col("p25")).withColumns({
        "lower": F.col("p25") - 1.5 * F.col("iqr"), "upper": F.col("p75") + 1.5 * F.col("iqr")})
    found = rows.collect()  # one row per column
    fences = df.sparkSession.createDataFrame(found, rows.schema)
    outside = [F.struct(F.lit(r["variable"]).alias("variable"), F.count_if(
        (_present(r["variable"]) < r["lower"]) | (_present(r["variable"]) > r["upper"])).alias("outliers")) for r in found]
    if not outside:
        outside = [F.struct(F.lit(None).cast("string").alias("variable"), F.lit(0).cast("long").alias("outliers"))]
    outliers = df.agg(F.array(*outside).alias("_rows")).select(F.inline("_rows"))
    return (moments.join(fences, "variable").join(outliers, "variable").select(
        "variable", "n", (100.0 - 100.0 * F.col("n") / total).alias("missing_pct"), "mean", "median", "sd", "min", "p25",
        "p75", "max", "iqr", "lower", "upper", "outliers", (100.0 * ratio("outliers", "n")).alias("outliers_pct"),
        "skew", "kurtosis"))


def trim_at_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or below the exact q quantile of the column."""
    cut = exact_quantiles(df.select(column), [], column, [q]).select("quantile").scalar()
    return df.filter(F.col(column) <= cut)


def log_advice(df: DataFrame, columns: list[str]) -> DataFrame:
    """Would log1p help? `binary`, `log` when |skew| > 1 falls by half, else `no`."""
    def skew(value: Column) -> Column:
        n = F.count(value).cast("double")
        return F.when(n > 2, ratio(F.skewness(value) * F.sqrt(n * (n - 1)), n - 2))

    long = long_numeric(df, columns)
    table = long.groupBy("variable").agg(
        skew(F.col("value")).alias("skew"), skew(log1p_nonnegative("value")).alias("skew_log1p"),
        F.min("value").alias("_min"), F.max("value").alias("_max"))
    # Two values at most means nothing lies strictly between minimum and maximum.
    between = with_group_columns(long, table.select("variable", "_min", "_max"), ["variable"]).groupBy("variable").agg(
        F.count_if((F.col("value") > F.col("_min")) & (F.col("value") < F.col("_max"))).alias("_inner"))
    return table.join(between, "variable").select(
        "variable", "skew", "skew_log1p",
        F.when(F.col("_inner") == 0, "binary")
        .when((F.abs("skew") > 1) & (F.abs("skew_log1p") < 0.5 * F.abs("skew")), "log").otherwise("no").alias("advice"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per class, with negatives per positive."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    n = F.col("n0") + F.col("n1")
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(f"n{k}").alias("n_rows"), (100.0 * ratio(F.col(f"n{k}"), n)).alias("pct"),
                 ratio("n0", "n1").alias("imbalance")) for k in (0, 1)])))


def label_definitions(df: DataFrame, status: str, positive: str, resolved: list[str]) -> DataFrame:
    """Rows, positives and rate when every row is labelled, and when only resolved rows are."""
    known = F.col(status).isin(resolved)
    hit = F.col(status) == positive
    row = df.agg(F.count("*").alias("n_all"), F.count_if(hit).alias("p_all"), F.count_if(known).alias("n_known"),
                 F.count_if(known & hit).alias("p_known"))
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("definition"), F.col(f"n_{k}").alias("n_rows"), F.col(f"p_{k}").alias("positives"),
                 ratio(f"p_{k}", f"n_{k}").alias("rate")) for name, k in (("all_rows", "all"), ("resolved_only", "known"))])))


def suspicious_values(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows meet each named rule, and their percent."""
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.count_if(v).alias("n_rows"), F.count("*").alias("_n"))
                     for k, v in rules.items()])
    return df.agg(rows.alias("_rows")).select(F.inline("_rows")).select(
        "rule", "n_rows", (100.0 * ratio("n_rows", "_n")).alias("pct"))


def resolved_by_period(df: DataFrame, period: str, resolved: Column, label: Column) -> DataFrame:
    """Issued and resolved rows per period, percent resolved, positive rate among resolved."""
    return df.groupBy(period).agg(
        F.count("*").alias("issued"), F.count_if(resolved).alias("resolved"),
        (100.0 * ratio(F.count_if(resolved), F.count("*"))).alias("pct_resolved"),
        F.avg(F.when(resolved, label.cast("double"))).alias("rate"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; exact ones come from grouping, not from one big set."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    long = df.select(F.inline(cells)).filter(F.col("v").isNotNull())
    if approximate:
        return long.groupBy("column").agg(F.approx_count_distinct("v").alias("n_distinct"))
    return long.distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))


def schema_profile(df: DataFrame) -> DataFrame:
    """Columns per data type with the row count of the table."""
    types: dict[str, int] = {}
    for field in df.schema.fields:
        types[field.dataType.simpleString()] = types.get(field.dataType.simpleString(), 0) + 1
    rows = F.array(*[F.struct(F.lit(t).alias("data_type"), F.lit(n).alias("n_columns"), F.count("*").alias("n_rows"))
                     for t, n in sorted(types.items())])
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def footer_rows(df: DataFrame, id_column: str, status: str) -> DataFrame:
    """Rows that are no records: id not a number or status missing (totals at the end of a file)."""
    return df.filter(F.col(id_column).try_cast("long").isNull() | F.col(status).isNull())


MOMENTS = "variable string, n long, nulls long, mean double, square double, least double, most double"


def column_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(variable, n, nulls, mean, square, least, most)` of numeric columns; `square` is the sum of squared deviations. One wide aggregation."""
    rows = F.array(*[F.struct(
        F.lit(c).alias("variable"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(F.col(c).cast("double")).alias("mean"),
        (F.var_pop(F.col(c).cast("double")) * F.count(c)).alias("square"), F.min(F.col(c).cast("double")).alias("least"),
        F.max(F.col(c).cast("double")).alias("most")) for c in columns])
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def keep_moments(df: DataFrame, columns: list[str], folder: str, part: str) -> None:
    """Writes the moments of one loaded part beside the data; a part that is loaded again replaces its own."""
    write_record(column_moments(df, columns), f"{folder}/part={part}")


def kept_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Moments of all parts together; deviations of parts are brought to the common mean."""
    parts = spark.read.schema(MOMENTS).json(f"{folder}/part=*").filter("n > 0 or nulls > 0")
    total = parts.groupBy("variable").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("mean"),
        F.sum("square").alias("_within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_raw"), F.min("least").alias("least"), F.max("most").alias("most"))
    between = F.col("_raw") - F.col("n") * F.col("mean") * F.col("mean")
    return total.select("variable", "n", "nulls", "mean", (F.col("_within") + F.greatest(between, F.lit(0.0))).alias("square"), "least", "most")


def moment_parity(df: DataFrame, kept: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Columns as they are now against the moments kept with the data: `(variable, mean, relative_diff, sd_diff, within)`.

    `within`: counts and nulls agree, and mean and deviation differ by no more than the tolerance, relative to the kept ones.
    """
    now = column_moments(df, columns)
    old = kept.select("variable", *[F.col(c).alias(f"_{c}") for c in ("n", "nulls", "mean", "square")])
    sd = lambda square, n: F.sqrt(F.try_divide(F.col(square), F.col(n)))
    apart = lambda a, b: F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12))
    joined = now.join(old, "variable").withColumns({
        "relative_diff": apart(F.col("mean"), F.col("_mean")), "sd_diff": apart(sd("square", "n"), sd("_square", "_n"))})
    same = (F.col("n") == F.col("_n")) & (F.col("nulls") == F.col("_nulls"))
    within = F.coalesce(same & (F.col("relative_diff") <= tolerance) & (F.col("sd_diff") <= tolerance), F.lit(False))
    return joined.select("variable", "mean", "relative_diff", "sd_diff", within.alias("within"))
