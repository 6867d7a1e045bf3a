"""Profiles of the feature frame and of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold import schema as S
from rankfold.functions.scalars import log10_from_one, log1p_nonnegative
from rankfold.operators import profile as P
from rankfold.operators import report as R
from rankfold.plans.catalog import BASE_SQL, base, chi2_tail_sql, query, r, rounded, table
from rankfold.plans.features import FEATURES_SQL, RAW_SQL, features, raw_text, stored_features

NULLABLE = ["dti", "revol_util", "mort_acc", "emp_length", "credit_history_years", "int_rate"]


@query("null_profile", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, "
    f"round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 9) AS pct FROM features" for c in S.FEATURES))
def null_profile(spark, sf):
    return rounded(P.null_profile(features(spark, sf), S.FEATURES), ["pct"])


@query("null_column_groups", """WITH raw AS (SELECT nullif(o_orderpriority, '1-URGENT') AS hardship_type,
  nullif(o_orderpriority, '2-HIGH') AS settlement_term, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS annual_inc_joint,
  CASE WHEN o_orderstatus = 'P' THEN 1 END AS sec_app_mort_acc, o_orderkey FROM orders)
SELECT "column", grp AS "group", round(pct, 9) AS pct FROM (
  SELECT 'hardship_type' AS "column", 'hardship' AS grp, 100.0::DOUBLE * count(*) FILTER (hardship_type IS NULL) / count(*) AS pct FROM raw
  UNION ALL SELECT 'settlement_term', 'settlement', 100.0::DOUBLE * count(*) FILTER (settlement_term IS NULL) / count(*) FROM raw
  UNION ALL SELECT 'annual_inc_joint', 'joint', 100.0::DOUBLE * count(*) FILTER (annual_inc_joint IS NULL) / count(*) FROM raw
  UNION ALL SELECT 'sec_app_mort_acc', 'joint', 100.0::DOUBLE * count(*) FILTER (sec_app_mort_acc IS NULL) / count(*) FROM raw
  UNION ALL SELECT 'o_orderkey', 'other', CAST(0 AS DOUBLE))""")
def null_column_groups(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("hardship_type"),
        F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")).alias("settlement_term"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("annual_inc_joint"),
        F.when(F.col("o_orderstatus") == "P", 1).alias("sec_app_mort_acc"), "o_orderkey")
    return P.null_profile(raw).select("column", P.column_group().alias("group"), r("pct").alias("pct"))


@query("null_by_period", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(100 * avg(CAST({c} IS NULL AS INTEGER)), 9) AS pct,
    round(100 * avg(CAST({c} IS NULL AS INTEGER)) FILTER (issue_year <= 1996), 9) AS pct_early,
    round(100 * avg(CAST({c} IS NULL AS INTEGER)) FILTER (issue_year >= 1999), 9) AS pct_late FROM features""" for c in NULLABLE))
def null_by_period(spark, sf):
    out = P.null_by_period(features(spark, sf), NULLABLE, F.col("issue_year") <= 1996, F.col("issue_year") >= 1999)
    return rounded(out, ["pct", "pct_early", "pct_late"])


@query("null_by_year", f"WITH {FEATURES_SQL} SELECT issue_year, " + ", ".join(
    f"round(100 * avg(CAST({c} IS NULL AS INTEGER)), 9) AS {c}" for c in NULLABLE) + " FROM features GROUP BY issue_year")
def null_by_year(spark, sf):
    return rounded(P.null_by_group(features(spark, sf), "issue_year", NULLABLE), NULLABLE)


@query("missing_vs_target", f"WITH {FEATURES_SQL}, parts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} IS NULL AS gone, \"default\" AS y FROM features" for c in NULLABLE) + f"""),
c AS (SELECT "column", CAST(count(*) FILTER (gone) AS DOUBLE) AS nm, CAST(count(*) FILTER (NOT gone) AS DOUBLE) AS np,
        CAST(count(*) FILTER (gone AND y = 1) AS DOUBLE) AS pm, CAST(count(*) FILTER (NOT gone AND y = 1) AS DOUBLE) AS pp
      FROM parts GROUP BY "column" HAVING count(*) FILTER (gone) > 0),
x AS (SELECT *, (nm + np) * pow(pm * (np - pp) - pp * (nm - pm), 2) / (nm * np * (pm + pp) * (nm + np - pm - pp)) AS chi2 FROM c)
SELECT "column", CAST(nm AS BIGINT) AS n_missing, CASE WHEN nm >= 10 THEN round(pm / nm, 9) END AS rate_missing, round(pp / np, 9) AS rate_present,
  CASE WHEN nm >= 10 THEN round(pm / nm - pp / np, 9) END AS diff, CASE WHEN nm >= 10 THEN round(chi2, 6) END AS chi2,
  CASE WHEN nm >= 10 THEN round({chi2_tail_sql('chi2', '1')}, 6) END AS p_value FROM x""")
def missing_vs_target(spark, sf):
    out = P.missing_vs_label(stored_features(spark, sf), NULLABLE, "default")
    return rounded(rounded(out, ["rate_missing", "rate_present", "diff"]), ["chi2", "p_value"], 6)


LINE_NUMERICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUARTILES_SQL = """quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS p75"""


@query("describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, min({c}) AS min,
    round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75,
    max({c}) AS max FROM lineitem""" for c in LINE_NUMERICS))
def describe(spark, sf):
    return rounded(rounded(P.describe(table(spark, sf, "lineitem"), LINE_NUMERICS), ["mean", "sd"], 4), ["p25", "median", "p75"], 6)


NUMERIC_PROFILE_SQL = f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, count({c}) AS n, round(100 * avg(CAST({c} IS NULL AS INTEGER)), 6) AS missing_pct,
    round(avg({c}), 4) AS mean, round(max(q.median), 4) AS median, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4) AS min, round(max(q.p25), 4) AS p25,
    round(max(q.p75), 4) AS p75, round(max({c}), 4) AS max, round(max(q.p75 - q.p25), 4) AS iqr, round(max(q.p25 - 1.5 * (q.p75 - q.p25)), 4) AS lower,
    round(max(q.p75 + 1.5 * (q.p75 - q.p25)), 4) AS upper,
    count(*) FILTER ({c} < q.p25 - 1.5 * (q.p75 - q.p25) OR {c} > q.p75 + 1.5 * (q.p75 - q.p25)) AS outliers,
    round(100.0::DOUBLE * count(*) FILTER ({c} < q.p25 - 1.5 * (q.p75 - q.p25) OR {c} > q.p75 + 1.5 * (q.p75 - q.p25)) / count({c}), 6) AS outliers_pct,
    round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis
    FROM features, (SELECT {QUARTILES_SQL.format(c=c)} FROM features) q""" for c in S.NUMERIC)


@query("numeric_profile", NUMERIC_PROFILE_SQL)
def numeric_profile(spark, sf):
    out = P.numeric_profile(stored_features(spark, sf), S.NUMERIC)
    money = ["mean", "median", "sd", "min", "p25", "p75", "max", "iqr", "lower", "upper"]
    return rounded(rounded(out, money, 4), ["missing_pct", "outliers_pct", "skew", "kurtosis"], 6)


@query("quantile_trim", """SELECT l_returnflag, count(*) AS n, round(max(l_extendedprice), 4) AS max_price FROM lineitem
WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.995) FROM lineitem) GROUP BY l_returnflag""")
def quantile_trim(spark, sf):
    kept = P.trim_at_quantile(table(spark, sf, "lineitem"), "l_extendedprice", 0.995)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.max("l_extendedprice"), 4).alias("max_price"))


@query("exact_median", "SELECT l_returnflag, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY l_returnflag")
def exact_median(spark, sf):
    return rounded(R.median_by(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"), ["median"], 6)


@query("log_transforms", """SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS log1p, round(log10(greatest(c_acctbal, 1)), 9) AS log10
FROM customer""")
def log_transforms(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r(log1p_nonnegative("c_acctbal")).alias("log1p"),
                                               r(log10_from_one("c_acctbal")).alias("log10"))


LOG_COLUMNS = ["loan_amnt", "installment", "annual_inc", "dti", "term_months", "delinq_2yrs", "revol_bal"]


@query("log_advice", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, round(skewness({c}), 6) AS skew, round(skewness(CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END), 6) AS skew_log1p,
    CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary'
         WHEN abs(skewness({c})) > 1 AND abs(skewness(CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END)) < 0.5 * abs(skewness({c})) THEN 'log' ELSE 'no' END AS advice
    FROM features""" for c in LOG_COLUMNS))
def log_advice(spark, sf):
    return rounded(P.log_advice(stored_features(spark, sf), LOG_COLUMNS), ["skew", "skew_log1p"], 6)


@query("frequency_table", """WITH t AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS level FROM orders
  UNION ALL SELECT 'o_orderpriority', nullif(o_orderpriority, '5-LOW') FROM orders)
SELECT "column", level, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 9) AS pct,
  100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders) < 1 AS rare FROM t GROUP BY ALL""")
def frequency_table(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    return rounded(P.frequency_table(rows, ["o_orderstatus", "o_orderpriority"]), ["pct"])


RATE_SQL = BASE_SQL + """, rates AS (SELECT n_name AS level, avg(y) AS rate, count(*) AS n_rows FROM base JOIN nation ON nationkey = n_nationkey
  GROUP BY n_name)"""


def _with_nation(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return base(spark, sf).join(nation, "nationkey")


@query("rate_by_level", f"WITH {RATE_SQL} SELECT level, round(rate, 9) AS rate, n_rows FROM rates WHERE n_rows >= 30 ORDER BY rates.rate DESC, level LIMIT 15")
def rate_by_level(spark, sf):
    return rounded(P.rate_by_level(_with_nation(spark, sf), "n_name", "y", 30, 15), ["rate"])


@query("head_tail", f"""WITH {RATE_SQL} SELECT * FROM (SELECT 'head' AS "end", level, round(rate, 9) AS rate, n_rows FROM rates ORDER BY rates.rate DESC, level LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'tail' AS "end", level, round(rate, 9) AS rate, n_rows FROM rates ORDER BY rates.rate, level DESC LIMIT 4)""")
def head_tail(spark, sf):
    rates = P.rate_by_level(_with_nation(spark, sf), "n_name", "y", 0, None)
    return rounded(P.head_and_tail(rates, "rate", "level", 4), ["rate"])


@query("class_balance", f"""WITH {BASE_SQL}, n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM base)
SELECT 0 AS "class", n0 AS n_rows, round(100.0::DOUBLE * n0 / (n0 + n1), 9) AS pct, round(n0 / n1, 9) AS imbalance FROM n
UNION ALL SELECT 1, n1, round(100.0::DOUBLE * n1 / (n0 + n1), 9), round(n0 / n1, 9) FROM n""")
def class_balance(spark, sf):
    return rounded(P.class_balance(base(spark, sf), "y"), ["pct", "imbalance"])


@query("label_definition_compare", """SELECT 'all_rows' AS definition, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS positives,
  round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 9) AS rate FROM orders
UNION ALL SELECT 'resolved_only', count(*), count(*) FILTER (o_orderstatus = 'F'), round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 9)
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def label_definition_compare(spark, sf):
    return rounded(P.label_definitions(table(spark, sf, "orders"), "o_orderstatus", "F", ["F", "O"]), ["rate"])


RULES = {"dti < 0": "dti < 0", "dti > 100": "dti > 100", "revol_util > 7": "revol_util > 7", "annual_inc < 0": "annual_inc < 0",
         "loan_amnt > 400000": "loan_amnt > 400000"}


@query("suspicious_values", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS n_rows, round(100.0::DOUBLE * count(*) FILTER ({v}) / count(*), 9) AS pct FROM features"
    for k, v in RULES.items()))
def suspicious_values(spark, sf):
    return rounded(P.suspicious_values(features(spark, sf), {k: F.expr(v) for k, v in RULES.items()}), ["pct"])


@query("year_censoring", """SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS issued, count(*) FILTER (o_orderstatus <> 'P') AS resolved,
  round(100.0::DOUBLE * count(*) FILTER (o_orderstatus <> 'P') / count(*), 9) AS pct_resolved,
  round(avg(CAST(o_orderstatus = 'F' AS INTEGER)) FILTER (o_orderstatus <> 'P'), 9) AS rate FROM orders GROUP BY ALL""")
def year_censoring(spark, sf):
    rows = table(spark, sf, "orders").withColumn("period", F.year("o_orderdate"))
    out = P.resolved_by_period(rows, "period", F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return rounded(out, ["pct_resolved", "rate"])


@query("distinct_counts", """SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS n_distinct FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders""")
def distinct_counts(spark, sf):
    return P.distinct_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_custkey", "o_orderstatus"])


@query("schema_profile", """SELECT data_type, CAST(n_columns AS INTEGER) AS n_columns, (SELECT count(*) FROM customer) AS n_rows
FROM (VALUES ('bigint', 1), ('double', 1), ('int', 1), ('string', 2)) t(data_type, n_columns)""")
def schema_profile(spark, sf):
    return P.schema_profile(table(spark, sf, "customer"))


FOOTER_SQL = f"""{RAW_SQL}, file AS (SELECT id, loan_status FROM raw UNION ALL
  SELECT 'Total amount: ' || CAST(round(sum(o_totalprice), 2) AS BIGINT), NULL FROM orders GROUP BY o_orderstatus)"""


@query("footer_rows", f"WITH {FOOTER_SQL} SELECT loan_status, count(*) AS n FROM file WHERE TRY_CAST(id AS BIGINT) IS NULL OR loan_status IS NULL GROUP BY ALL")
def footer_rows(spark, sf):
    """Totals rows at the end of a raw file are told from records by rule, not by position."""
    totals = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("v")).select(
        F.concat(F.lit("Total amount: "), F.col("v").cast("long").cast("string")).alias("id"), F.lit(None).cast("string").alias("loan_status"))
    file = raw_text(spark, sf).select("id", "loan_status").unionByName(totals)
    return P.footer_rows(file, "id", "loan_status").groupBy("loan_status").agg(F.count("*").alias("n"))
