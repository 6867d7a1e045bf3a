"""Association statistics on the feature frame and on the label tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from rankfold import schema as S
from rankfold.functions import text
from rankfold.operators import association as A
from rankfold.plans.catalog import (AUC_SQL, BASE_SQL, WIDE_SQL, base, chi2_tail_sql, curve_sql, normal_tail_sql, query, r, rounded, table,
                                    wide)
from rankfold.plans.features import FEATURES_SQL, RAW_SQL, features, raw_text, stored_features

LEVELS_SQL = BASE_SQL + """,
levels AS (SELECT id, y, CAST(period AS VARCHAR) AS period, priority, segment, n_name AS nation FROM base JOIN nation ON nationkey = n_nationkey)"""
CATEGORIES = ["priority", "segment", "nation", "period"]


def levels(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation"))
    return base(spark, sf).join(nation, "nationkey").select("id", "y", F.col("period").cast("string").alias("period"), "priority",
                                                            "segment", "nation")


@query("crosstab", f"""WITH {BASE_SQL} SELECT priority, count(*) FILTER (y = 0) AS "0", count(*) FILTER (y = 1) AS "1" FROM base GROUP BY priority""")
def crosstab(spark, sf):
    return A.crosstab(base(spark, sf), "priority", "y", [0, 1])


@query("crosstab_share", f"""WITH {BASE_SQL} SELECT priority, round(count(*) FILTER (y = 0) / count(*), 9) AS "0",
  round(count(*) FILTER (y = 1) / count(*), 9) AS "1" FROM base GROUP BY priority""")
def crosstab_share(spark, sf):
    return rounded(A.crosstab(base(spark, sf), "priority", "y", [0, 1], normalize=True), ["0", "1"])


def pairs_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    """CTE `v`: chi-square, sizes and bias-corrected V of each pair."""
    union = " UNION ALL ".join(f"SELECT '{a}' AS va, '{b}' AS vb, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {source} "
                               f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    return f"""cross_n AS (SELECT va, vb, a, b, CAST(count(*) AS DOUBLE) AS o FROM ({union}) GROUP BY ALL),
margins AS (SELECT *, sum(o) OVER (PARTITION BY va, vb, a) AS ra, sum(o) OVER (PARTITION BY va, vb, b) AS cb,
            sum(o) OVER (PARTITION BY va, vb) AS n FROM cross_n),
x AS (SELECT va, vb, max(n) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k, max(n) * (sum(o * o / (ra * cb)) - 1) AS chi2
      FROM margins GROUP BY va, vb),
v AS (SELECT *, (r - 1) * (k - 1) AS dof,
  sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / greatest(least(k - pow(k - 1, 2) / (n - 1) - 1, r - pow(r - 1, 2) / (n - 1) - 1), 1e-12)) AS cv
  FROM x)"""


@query("chi2_table", f"""WITH {LEVELS_SQL}, {pairs_sql('levels', [(c, 'y') for c in CATEGORIES])}
SELECT va AS variable, r AS levels, round(chi2, 6) AS chi2, dof, round({chi2_tail_sql('chi2', 'dof')}, 6) AS p_value, round(cv, 6) AS cramers_v FROM v""")
def chi2_table(spark, sf):
    return rounded(A.categorical_association(levels(spark, sf), CATEGORIES, "y"), ["chi2", "p_value", "cramers_v"], 6)


@query("cramers_v", f"""WITH {pairs_sql('labels', [('quality', 'toxic')])} SELECT round(chi2, 6) AS chi2, round(cv, 6) AS cramers_v FROM v""")
def cramers_v(spark, sf):
    out = A.categorical_association(table(spark, sf, "labels"), ["quality"], "toxic")
    return rounded(out.select("chi2", "cramers_v"), ["chi2", "cramers_v"], 6)


@query("cramers_v_matrix", f"""WITH {LEVELS_SQL}, {pairs_sql('levels', list(combinations(CATEGORIES, 2)))}
SELECT va AS var_a, vb AS var_b, round(cv, 6) AS cramers_v FROM v UNION ALL SELECT vb, va, round(cv, 6) FROM v
UNION ALL SELECT unnest({CATEGORIES}), unnest({CATEGORIES}), CAST(1 AS DOUBLE)""")
def cramers_v_matrix(spark, sf):
    return rounded(A.cramers_v_matrix(levels(spark, sf), CATEGORIES), ["cramers_v"], 6)


CONTINUOUS = [c for c in S.NUMERIC if c != "term_months"]
LONG_NUM_SQL = "num AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS value, \"default\" AS y FROM features WHERE {c} IS NOT NULL" for c in CONTINUOUS) + ")"
# Two-sided Student t as 1 - I_x(1/2, dof/2) by its hypergeometric series, x = t^2 / (dof + t^2).
T_TAIL_SQL = """1 - exp(0.5 * ln(tx) + t_dof / 2 * ln(1 - tx) - ln(0.5) - (lgamma(0.5) + lgamma(t_dof / 2) - lgamma(0.5 + t_dof / 2)))
  * (1 + list_sum(list_transform(range(0, 400), lambda i: exp((i + 1) * ln(tx)
      + lgamma(1.5) - lgamma(1.5 + i + 1) - lgamma(0.5 + t_dof / 2) + lgamma(0.5 + t_dof / 2 + i + 1)))))"""


@query("numeric_association", f"""WITH {FEATURES_SQL}, {LONG_NUM_SQL}, {curve_sql('num', 'variable', 'value')},
mo AS (SELECT variable, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, avg(value) FILTER (y = 1) AS mean1,
         avg(value) FILTER (y = 0) AS mean0, var_samp(value) FILTER (y = 1) AS v1, var_samp(value) FILTER (y = 0) AS v0, corr(y, value) AS rb
       FROM num GROUP BY variable),
u AS (SELECT variable, sum(pos * (neg_below + neg / 2)) AS u, sum(pow(pos + neg, 3) - (pos + neg)) AS ties FROM curve GROUP BY variable),
s AS (SELECT *, mean1 - mean0 AS diff, (mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d,
        (mean1 - mean0) / sqrt(v1 / n1 + v0 / n0) AS t,
        pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS t_dof,
        (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS uz
      FROM mo JOIN u USING (variable)),
sx AS (SELECT *, t * t / (t_dof + t * t) AS tx FROM s)
SELECT variable, round(mean1, 4) AS mean1, round(mean0, 4) AS mean0, round(diff, 4) AS diff, round(d, 6) AS cohens_d, round(rb, 6) AS point_biserial,
  round(t, 6) AS t, round(t_dof, 3) AS t_dof, round({T_TAIL_SQL}, 6) AS p_welch, u, round(uz, 6) AS u_z,
  CASE WHEN uz < 0 THEN CAST(1 AS DOUBLE) ELSE round({normal_tail_sql('uz')}, 6) END AS p_mann_whitney FROM sx""")
def numeric_association(spark, sf):
    out = A.numeric_association(stored_features(spark, sf), CONTINUOUS, "default")
    out = rounded(rounded(out, ["mean1", "mean0", "diff"], 4), ["t_dof"], 3)
    return rounded(out, ["cohens_d", "point_biserial", "t", "p_welch", "u_z", "p_mann_whitney"], 6)


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pearson_matrix", "SELECT variable, " + ", ".join(f"round({c}, 6) AS {c}" for c in LINE_COLUMNS) + " FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable, " + ", ".join("CAST(1 AS DOUBLE) AS " + b if a == b else f"corr(nullif({a}, 1), nullif({b}, 1)) AS {b}"
                                              for b in LINE_COLUMNS) + " FROM lineitem" for a in LINE_COLUMNS) + ")")
def pearson_matrix(spark, sf):
    """Pairwise complete: quantity 1 is made null, so its pairs use fewer rows."""
    rows = table(spark, sf, "lineitem").select(*[F.nullif(F.col(c), F.lit(1.0)).alias(c) for c in LINE_COLUMNS])
    return rounded(A.pearson_matrix(rows, LINE_COLUMNS), LINE_COLUMNS, 6)


CORR_COLUMNS = ["loan_amnt", "installment", "revol_bal", "open_acc", "total_acc", "dti", "delinq_2yrs", "inq_last_6mths"]


@query("high_corr_pairs", f"WITH {FEATURES_SQL}, p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r FROM features" for a, b in combinations(CORR_COLUMNS, 2)) +
    ") SELECT var_a, var_b, round(r, 6) AS r FROM p WHERE abs(r) > 0.7")
def high_corr_pairs(spark, sf):
    return rounded(A.high_correlation(features(spark, sf), CORR_COLUMNS), ["r"], 6)


@query("ordinal_corr", f"""WITH {BASE_SQL}, coded AS (SELECT *, dense_rank() OVER (ORDER BY priority) - 1 AS code FROM base)
SELECT count(*) AS n, CAST(max(code) AS BIGINT) AS max_code, round(corr(price, code), 6) AS r FROM coded""")
def ordinal_corr(spark, sf):
    coded = A.ordinal_code(base(spark, sf), "priority", "code")
    return coded.agg(F.count("*").alias("n"), F.max("code").alias("max_code"), r(F.corr("price", "code"), 6).alias("r"))


@query("redundancy_check", f"""WITH {FEATURES_SQL}, joined AS (SELECT f.*, raw.loan_amnt AS funded, raw.total_acc AS all_acc FROM features f JOIN raw USING (id))
SELECT 'loan_amnt' AS var_a, 'funded' AS var_b, round(corr(loan_amnt, funded), 6) AS r FROM joined
UNION ALL SELECT 'open_acc', 'all_acc', round(corr(open_acc, all_acc), 6) FROM joined""")
def redundancy_check(spark, sf):
    extra = raw_text(spark, sf).select("id", text.number("loan_amnt").alias("funded"), text.number("total_acc").alias("all_acc"))
    pairs = [("loan_amnt", "funded"), ("open_acc", "all_acc")]
    return rounded(A.redundancy(features(spark, sf), extra, pairs), ["r"], 6)


AUDIT = ["loan_amnt", "annual_inc", "dti", "installment", "delinq_2yrs"]
#: What becomes known after the loan was made, as expressions of the raw row that Spark and SQL read alike; dates lag the issue month.
_BAD = "loan_status = 'Charged Off'"
_AMOUNT, _PART = "CAST(loan_amnt AS DOUBLE)", "CAST(installment AS DOUBLE)"
LATER = {
    "out_prncp": f"{_AMOUNT} * (k % 5)", "out_prncp_inv": f"{_AMOUNT} * (k % 7)",
    "total_pymnt": f"CASE WHEN {_BAD} THEN {_AMOUNT} / 4 ELSE {_AMOUNT} END", "total_pymnt_inv": f"CASE WHEN {_BAD} THEN {_AMOUNT} / 4 ELSE {_AMOUNT} END - k % 100",
    "total_rec_prncp": f"CASE WHEN {_BAD} THEN {_AMOUNT} / 8 ELSE {_AMOUNT} / 2 END", "total_rec_int": f"{_PART} / 16",
    "total_rec_late_fee": f"CASE WHEN {_BAD} AND k % 3 = 0 THEN 15 ELSE 0 END", "recoveries": f"CASE WHEN {_BAD} THEN {_AMOUNT} / 16 ELSE 0 END",
    "collection_recovery_fee": f"CASE WHEN {_BAD} THEN {_PART} * (k % 2) ELSE 0 END", "last_pymnt_amnt": f"CASE WHEN k % 13 = 0 THEN NULL ELSE {_PART} END",
    "last_fico_range_high": "CAST(fico_range_high AS DOUBLE) * 10", "last_fico_range_low": "CAST(fico_range_high AS DOUBLE) * 10 - k % 4",
    "last_pymnt_d": f"CASE WHEN {_BAD} THEN 6 ELSE 30 END", "next_pymnt_d": "CASE WHEN k % 3 = 0 THEN NULL ELSE 1 END", "last_credit_pull_d": "k % 40",
}
_DATES = [c for c in S.POST_ORIGINATION if c.endswith("_d")]


def later_rows(spark, sf):
    """Resolved raw rows, all text, with the columns that became known later."""
    raw = raw_text(spark, sf).filter(F.col("loan_status").isin(S.RESOLVED)).withColumn("k", F.col("id").cast("long"))
    months = lambda c: F.date_format(F.add_months(F.to_date("issue_d", "MMM-yyyy"), F.expr(LATER[c]).cast("int")), "MMM-yyyy")
    return raw.withColumns({c: months(c) if c in _DATES else F.expr(LATER[c]).cast("string") for c in S.POST_ORIGINATION})


def _later_sql(column: str) -> str:
    if column not in _DATES:
        return f"CAST({LATER[column]} AS DOUBLE)"
    month = f"(strptime(issue_d, '%b-%Y') + to_months(CAST({LATER[column]} AS INTEGER)))"
    return f"(year({month}) + (month({month}) - 1) / CAST(12 AS DOUBLE))"


AUDIT_SQL = "audit AS (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS variable, \"default\" AS y, coalesce({c}, -1) AS value FROM features" for c in AUDIT]
    + [f"SELECT '{c}', CAST({_BAD} AS INTEGER), coalesce({_later_sql(c)}, -1) FROM raw WHERE loan_status <> 'Current'" for c in S.POST_ORIGINATION]) + ")"


@query("leakage_audit", f"""WITH {FEATURES_SQL}, {AUDIT_SQL}, {curve_sql('audit', 'variable', 'value')},
a AS (SELECT variable, {AUC_SQL} AS a FROM curve GROUP BY variable)
SELECT variable, round(greatest(a, 1 - a), 9) AS auc FROM a""")
def leakage_audit(spark, sf):
    """Five columns known when the loan was made beside all fifteen that came later, three of them dates."""
    rows = later_rows(spark, sf).withColumn("default", (F.col("loan_status") == S.POSITIVE).cast("int"))
    return rounded(A.leakage_audit(rows, [*AUDIT, *S.POST_ORIGINATION], "default"), ["auc"])


@query("mann_whitney_scores", f"""WITH {WIDE_SQL}, long AS (SELECT 'm1' AS variable, y, m1 AS score FROM wide UNION ALL SELECT 'm2', y, m2 FROM wide),
{curve_sql('long', 'variable')}
SELECT variable, sum(pos * (neg_below + neg / 2)) AS u FROM curve GROUP BY variable""")
def mann_whitney_scores(spark, sf):
    long = wide(spark, sf).unpivot(["y"], ["m1", "m2"], "variable", "value")
    return A.mann_whitney(long).select("variable", "u")
