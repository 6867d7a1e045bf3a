"""Raw text rows made from the tables, and everything that turns them into features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankfold import schema as S
from rankfold.functions import text
from rankfold.operators import compare as C
from rankfold.operators import features as X
from rankfold.operators import profile as P
from rankfold.operators.split import make_split
from rankfold.plans.catalog import BASE_SQL, WIDE_SQL, base, query, r, rounded, table, wide
from rankfold.plans.splitting import SPLIT_SQL
from rankfold.session import materialize, scratch_path


def raw_text(spark, sf) -> DataFrame:
    """Every order as a raw loan row, all columns text, with gaps and malformed values."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"), F.min("l_quantity").alias("min_qty"),
        F.max("l_extendedprice").alias("max_price"), F.max("l_discount").alias("max_disc"), F.max("l_tax").alias("max_tax"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.count_if(F.col("l_linestatus") == "O").alias("n_o"),
        F.max("l_returnflag").alias("flag"))
    joined = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    k, ck = F.col("o_orderkey"), F.col("o_custkey")

    def t(c):
        return (F.col(c) if isinstance(c, str) else c).cast("string")

    earlier = F.date_sub(F.col("o_orderdate").cast("date"), (ck % 4000).cast("int"))
    tenure = ck % 13
    return joined.select(
        t(k).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "Charged Off").when(F.col("o_orderstatus") == "O", "Fully Paid")
        .otherwise("Current").alias("loan_status"),
        F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
        F.when(k % 2 == 0, " 36 months").otherwise(" 60 months").alias("term"),
        F.when(tenure == 0, None).when(tenure == 1, "< 1 year").when(tenure == 11, "10+ years").when(tenure == 12, "n/a")
        .otherwise(F.concat(t(tenure), F.lit(" years"))).alias("emp_length"),
        F.when(k % 11 == 0, "Xxx-2001").when(k % 29 == 0, None).otherwise(F.date_format(earlier, "MMM-yyyy")).alias("earliest_cr_line"),
        t("o_totalprice").alias("loan_amnt"), t(F.col("max_disc") * 100).alias("int_rate"), t("max_price").alias("installment"),
        t("c_acctbal").alias("annual_inc"),
        F.when(k % 17 == 0, "n/a").when(k % 19 == 0, "-1").otherwise(t("qty")).alias("dti"),
        t("min_qty").alias("fico_range_high"), t("n_lines").alias("open_acc"), t(F.col("max_price") * 2).alias("revol_bal"),
        F.when(k % 23 == 0, None).otherwise(t(F.col("max_tax") * 100)).alias("revol_util"), t(F.col("n_lines") + k % 5).alias("total_acc"),
        t(k % 3).alias("pub_rec"), t("n_r").alias("delinq_2yrs"), t("n_o").alias("inq_last_6mths"),
        F.when(k % 7 == 0, None).otherwise(t(ck % 5)).alias("mort_acc"),
        F.col("o_orderpriority").alias("purpose"), F.col("c_mktsegment").alias("home_ownership"),
        F.when(k % 31 == 0, None).otherwise(F.col("n_name")).alias("addr_state"), F.col("flag").alias("verification_status"))


RAW_SQL = """lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price,
         max(l_discount) AS max_disc, max(l_tax) AS max_tax, count(*) FILTER (l_returnflag = 'R') AS n_r,
         count(*) FILTER (l_linestatus = 'O') AS n_o, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k,
    CASE o_orderstatus WHEN 'F' THEN 'Charged Off' WHEN 'O' THEN 'Fully Paid' ELSE 'Current' END AS loan_status,
    strftime(o_orderdate, '%b-%Y') AS issue_d, CASE WHEN o_orderkey % 2 = 0 THEN ' 36 months' ELSE ' 60 months' END AS term,
    CASE o_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '< 1 year' WHEN 11 THEN '10+ years' WHEN 12 THEN 'n/a'
         ELSE (o_custkey % 13) || ' years' END AS emp_length,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Xxx-2001' WHEN o_orderkey % 29 = 0 THEN NULL
         ELSE strftime(CAST(o_orderdate AS DATE) - CAST(o_custkey % 4000 AS INTEGER), '%b-%Y') END AS earliest_cr_line,
    o_totalprice AS loan_amnt, max_disc * 100 AS int_rate, max_price AS installment, c_acctbal AS annual_inc,
    CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 19 = 0 THEN '-1' ELSE CAST(qty AS VARCHAR) END AS dti,
    min_qty AS fico_range_high, CAST(n_lines AS DOUBLE) AS open_acc, max_price * 2 AS revol_bal,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE max_tax * 100 END AS revol_util, CAST(n_lines + o_orderkey % 5 AS DOUBLE) AS total_acc,
    CAST(o_orderkey % 3 AS DOUBLE) AS pub_rec, CAST(n_r AS DOUBLE) AS delinq_2yrs, CAST(n_o AS DOUBLE) AS inq_last_6mths,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 5 AS DOUBLE) END AS mort_acc,
    o_orderpriority AS purpose, c_mktsegment AS home_ownership, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE n_name END AS addr_state,
    flag AS verification_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN lines ON o_orderkey = l_orderkey)"""
YEAR_MONTH_SQL = """(TRY_CAST(right({c}, 4) AS DOUBLE) + (CAST(CASE left({c}, 3) WHEN 'Jan' THEN 1 WHEN 'Feb' THEN 2 WHEN 'Mar' THEN 3
  WHEN 'Apr' THEN 4 WHEN 'May' THEN 5 WHEN 'Jun' THEN 6 WHEN 'Jul' THEN 7 WHEN 'Aug' THEN 8 WHEN 'Sep' THEN 9 WHEN 'Oct' THEN 10
  WHEN 'Nov' THEN 11 WHEN 'Dec' THEN 12 END AS DOUBLE) - 1) / CAST(12 AS DOUBLE))"""
EMP_SQL = """CASE WHEN starts_with(emp_length, '<') THEN CAST(0 AS DOUBLE)
  ELSE TRY_CAST(nullif(regexp_extract(emp_length, '(\\d+)', 1), '') AS DOUBLE) END"""
TERM_SQL = "TRY_CAST(regexp_extract(term, '(\\d+)', 1) AS DOUBLE)"
HISTORY_SQL = f"{YEAR_MONTH_SQL.format(c='issue_d')} - {YEAR_MONTH_SQL.format(c='earliest_cr_line')}"
FEATURES_SQL = RAW_SQL + f""",
features AS (
  SELECT id, CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS "default", TRY_CAST(right(issue_d, 4) AS INTEGER) AS issue_year,
    {', '.join(c if c != 'dti' else 'TRY_CAST(dti AS DOUBLE) AS dti' for c in S.NUMERIC_RAW)},
    {EMP_SQL} AS emp_length, {HISTORY_SQL} AS credit_history_years, {TERM_SQL} AS term_months,
    {', '.join(f"coalesce({c}, '{S.UNKNOWN_LEVEL}') AS {c}" for c in S.CATEGORICAL)}
  FROM raw WHERE loan_status IN ('Fully Paid', 'Charged Off'))"""


def features(spark, sf) -> DataFrame:
    return X.model_frame(raw_text(spark, sf))


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_features(spark, sf) -> DataFrame:
    """Feature frame written once per session; profiles and fits read it in several passes."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = materialize(features(spark, sf))
    return _STORED[key]


@query("feature_frame", f"""WITH {FEATURES_SQL} SELECT id, "default", issue_year,
  {', '.join(f'round({c}, 6) AS {c}' for c in S.NUMERIC)}, {', '.join(S.CATEGORICAL)} FROM features""")
def feature_frame(spark, sf):
    return rounded(features(spark, sf), S.NUMERIC, 6)


@query("year_month_parse", f"""WITH {RAW_SQL} SELECT id, round({YEAR_MONTH_SQL.format(c='issue_d')}, 9) AS issued,
  round({YEAR_MONTH_SQL.format(c='earliest_cr_line')}, 9) AS earliest, round({HISTORY_SQL}, 9) AS years,
  TRY_CAST(right(issue_d, 4) AS INTEGER) AS year FROM raw""")
def year_month_parse(spark, sf):
    return raw_text(spark, sf).select("id", r(text.year_month("issue_d")).alias("issued"),
                                      r(text.year_month("earliest_cr_line")).alias("earliest"),
                                      r(text.years_between("issue_d", "earliest_cr_line")).alias("years"),
                                      text.text_year("issue_d").alias("year"))


@query("first_int_parse", f"WITH {RAW_SQL} SELECT id, {TERM_SQL} AS term_months, TRY_CAST(dti AS DOUBLE) AS dti FROM raw")
def first_int_parse(spark, sf):
    return raw_text(spark, sf).select("id", text.first_integer("term").alias("term_months"), text.number("dti").alias("dti"))


@query("duration_parse", f"WITH {RAW_SQL} SELECT id, emp_length AS source, {EMP_SQL} AS emp_length FROM raw")
def duration_parse(spark, sf):
    return raw_text(spark, sf).select("id", F.col("emp_length").alias("source"), text.duration_years("emp_length").alias("emp_length"))


@query("head_part", "SELECT n_nationkey, split_part(n_name || ':' || n_regionkey, ':', 1) AS head FROM nation")
def head_part(spark, sf):
    joined = F.concat_ws(":", F.col("n_name"), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", text.head_part(joined).alias("head"))


@query("sentinel_fill", f"WITH {FEATURES_SQL} SELECT id, coalesce(dti, -1) AS dti, coalesce(mort_acc, -1) AS mort_acc, "
       "coalesce(emp_length, -1) AS emp_length FROM features")
def sentinel_fill(spark, sf):
    return X.fill_sentinel(features(spark, sf).select("id", "dti", "mort_acc", "emp_length"), ["dti", "mort_acc", "emp_length"])


# Test rows are folded with levels learned on training rows; 5 percent makes some nations rare.
FOLD_COLUMNS = ["purpose", "addr_state", "verification_status"]
FOLD_SQL = FEATURES_SQL + ", " + SPLIT_SQL + """,
tagged AS (SELECT f.*, s.split FROM features f JOIN split s ON f.id = CAST(s.id AS VARCHAR)),
train AS (SELECT * FROM tagged WHERE split = 'train'),
""" + ",\n".join(f"keep_{c} AS (SELECT {c} AS level FROM train GROUP BY {c} HAVING count(*) >= 0.04::DOUBLE * (SELECT count(*) FROM train))"
                 for c in FOLD_COLUMNS)


def _split_features(spark, sf):
    split = make_split(base(spark, sf), "id", "y").withColumn("id", F.col("id").cast("string"))
    return stored_features(spark, sf).join(split.select("id", "split"), "id")


@query("rare_level_fold", f"WITH {FOLD_SQL} SELECT id, split, " + ", ".join(
    f"CASE WHEN {c} IN (SELECT level FROM keep_{c}) THEN {c} ELSE '{S.RARE_LEVEL}' END AS {c}" for c in FOLD_COLUMNS) + " FROM tagged")
def rare_level_fold(spark, sf):
    rows = _split_features(spark, sf).select("id", "split", *FOLD_COLUMNS)
    kept = X.kept_levels(rows.filter("split = 'train'"), FOLD_COLUMNS, 0.04)
    return X.fold_rare(rows, kept, FOLD_COLUMNS)


@query("level_difference", f"WITH {FOLD_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", level FROM (SELECT {c} AS level FROM train EXCEPT SELECT level FROM keep_{c})" for c in FOLD_COLUMNS))
def level_difference(spark, sf):
    rows = _split_features(spark, sf).filter("split = 'train'")
    return X.rare_levels(rows, FOLD_COLUMNS, 0.04)


SCALED = ["loan_amnt", "annual_inc", "open_acc"]


@query("scaled_moments", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, round(avg(z), 6) AS mean, round(stddev_samp(z), 6) AS sd, round(max(z), 6) AS max FROM
    (SELECT (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM (SELECT coalesce({c}, -1) AS x FROM features))""" for c in SCALED))
def scaled_moments(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = X.fill_sentinel(features(spark, sf).select("id", *SCALED), SCALED)
    fitted = X.vector_pipeline(SCALED, []).fit(rows)
    z = fitted.transform(rows).select(F.posexplode(vector_to_array("features_sc")).alias("i", "z"))
    stats = z.groupBy("i").agg(F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"), F.max("z").alias("max"))
    names = F.array(*[F.lit(c) for c in SCALED])
    # 0.0 turns a rounded -0.0 into 0.
    return stats.select(F.get(names, F.col("i")).alias("variable"), (r("mean", 6) + 0.0).alias("mean"), r("sd", 6).alias("sd"),
                        r("max", 6).alias("max"))


@query("join_cardinality", f"""WITH {SPLIT_SQL} SELECT (SELECT count(*) FROM base) AS n_left, (SELECT count(*) FROM split) AS n_right,
  (SELECT count(*) FROM base JOIN split USING (id)) AS n_joined,
  (SELECT count(*) FROM (SELECT id FROM base GROUP BY id HAVING count(*) > 1)) AS repeated_left,
  (SELECT count(*) FROM (SELECT id FROM split GROUP BY id HAVING count(*) > 1)) AS repeated_right,
  (SELECT count(*) FROM (SELECT id FROM split EXCEPT SELECT id FROM base)) AS only_right,
  (SELECT count(*) FROM (SELECT id FROM base EXCEPT SELECT id FROM split)) AS only_left""")
def join_cardinality(spark, sf):
    rows = base(spark, sf)
    return X.join_check(rows.select("id"), make_split(rows, "id", "y").select("id"), "id")


@query("partition_join", f"WITH {SPLIT_SQL} SELECT base.id, price, split, fold FROM base JOIN split USING (id)")
def partition_join(spark, sf):
    rows = base(spark, sf)
    return rows.join(make_split(rows, "id", "y"), "id").select("id", "price", "split", "fold")


@query("score_join_check", f"""WITH {WIDE_SQL}, other AS (SELECT id, CASE WHEN m1 > 0.9 THEN 1 - y ELSE y END AS y, m2 AS score FROM wide
  WHERE m2 < 0.95)
SELECT (SELECT count(*) FROM wide) AS n_base, (SELECT count(*) FROM other) AS n_other,
  (SELECT count(*) FROM wide LEFT JOIN other USING (id) WHERE other.score IS NULL) AS missing_score,
  (SELECT count(*) FROM wide JOIN other USING (id) WHERE wide.y <> other.y) AS label_differs, 0::BIGINT AS surplus, FALSE AS identical""")
def score_join_check(spark, sf):
    scores = wide(spark, sf)
    other = scores.filter(F.col("m2") < 0.95).select(
        "id", F.when(F.col("m1") > 0.9, 1 - F.col("y")).otherwise(F.col("y")).alias("y"), F.col("m2").alias("score"))
    return C.score_join_check(scores.select("id", "y"), other)


@query("score_inner_join", f"WITH {WIDE_SQL} SELECT a.id, a.y, a.m1 AS p1, b.m2 AS p2 FROM wide a JOIN wide b ON a.id = b.id")
def score_inner_join(spark, sf):
    scores = wide(spark, sf)
    return scores.select("id", "y", F.col("m1").alias("p1")).join(scores.select("id", F.col("m2").alias("p2")), "id")


@query("score_attach", f"WITH {WIDE_SQL} SELECT a.id, a.y, b.m3 AS m3 FROM wide a LEFT JOIN (SELECT * FROM wide WHERE m3 >= 0.3) b ON a.id = b.id")
def score_attach(spark, sf):
    scores = wide(spark, sf)
    return C.attach_scores(scores.select("id", "y"), scores.filter("m3 >= 0.3").select("id", F.col("m3").alias("score")), "m3")


@query("key_alignment", f"""WITH {RAW_SQL}, {BASE_SQL} SELECT base.id, y, loan_amnt, revol_bal FROM base JOIN raw ON raw.k = base.id""")
def key_alignment(spark, sf):
    """Model rows with raw columns kept outside the model, aligned by key instead of position."""
    extra = raw_text(spark, sf).select(text.number("id").cast("long").alias("id"), text.number("loan_amnt").alias("loan_amnt"),
                                       text.number("revol_bal").alias("revol_bal"))
    return base(spark, sf).select("id", "y").join(extra, "id")


@query("range_filters", f"""WITH {FEATURES_SQL} SELECT id, dti, issue_year, term_months FROM features
WHERE dti BETWEEN 0 AND 60 AND issue_year <= 1998 AND term_months = 36""")
def range_filters(spark, sf):
    return features(spark, sf).filter(
        F.col("dti").between(0, 60) & (F.col("issue_year") <= 1998) & (F.col("term_months") == 36)
    ).select("id", "dti", "issue_year", "term_months")


PARITY = ["loan_amnt", "annual_inc", "open_acc", "term_months"]


#: How the second state of the table differs from the one whose moments were kept: a shift, a scale, a gap and nothing.
CHANGES = {"loan_amnt": "loan_amnt + 100", "annual_inc": "annual_inc * 2", "open_acc": "CASE WHEN issue_year = 1995 THEN NULL ELSE open_acc END",
           "term_months": "term_months"}
PARITY_SQL = ", ".join(
    f"{state} AS (SELECT issue_year, {', '.join(f'{(CHANGES[c] if changed else c)} AS {c}' for c in PARITY)} FROM features)"
    for state, changed in (("as_kept", False), ("changed", True)))


def _parity_row(state: str, c: str) -> str:
    return f"""SELECT '{state}' AS state, '{c}' AS variable, round(avg(s.{c}), 4) AS mean, round(abs(avg(s.{c}) - any_value(k.m)) / greatest(abs(any_value(k.m)), 1e-12), 6) AS relative_diff,
  round(abs(stddev_pop(s.{c}) - any_value(k.sd)) / greatest(any_value(k.sd), 1e-12), 6) AS sd_diff,
  count(s.{c}) = any_value(k.n) AND abs(avg(s.{c}) - any_value(k.m)) <= 1e-6 * abs(any_value(k.m)) AND abs(stddev_pop(s.{c}) - any_value(k.sd)) <= 1e-6 * any_value(k.sd) AS within
FROM {state} s, (SELECT avg({c}) AS m, stddev_pop({c}) AS sd, count({c}) AS n FROM features) k"""


@query("feature_parity", f"WITH {FEATURES_SQL}, {PARITY_SQL} " + " UNION ALL ".join(_parity_row(state, c) for state in ("as_kept", "changed") for c in PARITY))
def feature_parity(spark, sf):
    """The feature table and a changed one against moments that were kept when the raw rows were loaded, in two loads."""
    rows = stored_features(spark, sf)
    loaded = raw_text(spark, sf).filter(F.col("loan_status").isin(S.RESOLVED)).select(
        text.text_year("issue_d").alias("issue_year"), *[(text.first_integer("term") if c == "term_months" else text.number(c)).alias(c) for c in PARITY])
    folder = scratch_path(spark, "moments")
    for part, years in (("early", F.col("issue_year") < 1995), ("late", F.col("issue_year") >= 1995)):
        P.keep_moments(loaded.filter(years), PARITY, folder, part)
    kept = materialize(P.kept_moments(spark, folder))
    states = {"as_kept": rows, "changed": rows.select("issue_year", *[F.expr(CHANGES[c]).alias(c) for c in PARITY])}
    out = [P.moment_parity(df, kept, PARITY).withColumn("state", F.lit(state)) for state, df in states.items()]
    return rounded(rounded(out[0].unionByName(out[1]), ["mean"], 4), ["relative_diff", "sd_diff"], 6)


@query("union_rows", f"WITH {WIDE_SQL} SELECT id, m1 AS score FROM wide WHERE y = 1 UNION ALL SELECT id, m2 FROM wide WHERE y = 0")
def union_rows(spark, sf):
    scores = wide(spark, sf)
    return scores.filter("y = 1").select("id", F.col("m1").alias("score")).unionByName(
        scores.filter("y = 0").select("id", F.col("m2").alias("score")))
