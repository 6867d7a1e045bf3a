"""Paired comparison of the score columns."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from pyspark.sql import functions as F

from rankfold.functions.scalars import neg_log10_p, p_label
from rankfold.operators import compare as C
from rankfold.operators import resample as B
from rankfold.operators.counterboot import replicates_sql
from rankfold.operators.split import hash_sample
from rankfold.plans.catalog import (LONG_SQL, MODELS, THRESHOLDS, WIDE_SQL, curve_sql, normal_tail_sql, query, r, rounded, table, wide)

Q = NormalDist().inv_cdf(0.975)
PAIRS = list(combinations(MODELS, 2))


def pairs_values(pairs) -> str:
    return "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") t(model_a, model_b))"


COMPONENT_SQL = f"""{LONG_SQL}, {curve_sql('long', 'model')},
comp AS (SELECT id, y, model, CASE WHEN y = 1 THEN (neg_below + neg / 2) / neg_total ELSE 1 - (pos_below + pos / 2) / pos_total END AS c
         FROM long JOIN curve USING (model, score))"""


def delong_sql(pairs) -> str:
    """CTE `d`: everything DeLong's comparison reports for the given pairs."""
    return f"""{COMPONENT_SQL}, {pairs_values(pairs)},
parts AS (SELECT model_a, model_b, a.y, count(*) AS n, avg(a.c) AS m1, avg(b.c) AS m2, covar_samp(a.c, b.c) / count(*) AS cv,
                 var_samp(a.c) / count(*) AS v1, var_samp(b.c) / count(*) AS v2
          FROM pairs JOIN comp a ON a.model = model_a JOIN comp b ON b.model = model_b AND b.id = a.id GROUP BY model_a, model_b, a.y),
agg AS (SELECT model_a, model_b, max(m1) FILTER (y = 1) AS auc1, max(m2) FILTER (y = 1) AS auc2, sum(v1) AS v1, sum(v2) AS v2, sum(cv) AS cv
        FROM parts GROUP BY model_a, model_b),
d AS (SELECT *, auc1 - auc2 AS delta, sqrt(greatest(v1 + v2 - 2 * cv, 0)) AS se, (auc1 - auc2) / sqrt(greatest(v1 + v2 - 2 * cv, 0)) AS z,
             cv / sqrt(v1 * v2) AS corr_auc FROM agg)"""


DELONG_COLUMNS = ["auc1", "auc2", "auc1_lo", "auc1_hi", "auc2_lo", "auc2_hi", "delta", "delta_lo", "delta_hi", "se", "z", "corr_auc"]
DELONG_SELECT = f"""model_a, model_b, round(auc1, 9) AS auc1, round(auc2, 9) AS auc2, round(greatest(auc1 - {Q} * sqrt(v1), 0), 9) AS auc1_lo,
  round(least(auc1 + {Q} * sqrt(v1), 1), 9) AS auc1_hi, round(greatest(auc2 - {Q} * sqrt(v2), 0), 9) AS auc2_lo,
  round(least(auc2 + {Q} * sqrt(v2), 1), 9) AS auc2_hi, round(delta, 9) AS delta, round(delta - {Q} * se, 9) AS delta_lo,
  round(delta + {Q} * se, 9) AS delta_hi, round(se, 9) AS se, round(z, 7) AS z, round({normal_tail_sql('z')}, 7) AS p_value, round(corr_auc, 7) AS corr_auc"""


def _rounded_delong(df):
    return rounded(rounded(df, [c for c in DELONG_COLUMNS if c not in ("z", "corr_auc")]), ["z", "p_value", "corr_auc"], 7)


@query("delong_pair", f"WITH {delong_sql([('m1', 'm2')])} SELECT {DELONG_SELECT} FROM d")
def delong_pair(spark, sf):
    return _rounded_delong(C.delong(wide(spark, sf).select("id", "y", "m1", "m2"), ["m1", "m2"]))


HOLM_SQL = """h AS (SELECT *, least(1, max((m - rk + 1) * p) OVER (PARTITION BY family ORDER BY rk)) AS p_holm FROM (
  SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS rk FROM src))"""


@query("delong_all_pairs", f"""WITH {delong_sql(PAIRS)}, src AS (SELECT *, 'all' AS family, {normal_tail_sql('z')} AS p FROM d), {HOLM_SQL}
SELECT {DELONG_SELECT}, family, round(p_holm, 7) AS p_holm, p_holm < 0.05 AS significant, abs(delta) >= 0.005 AS relevant FROM h""")
def delong_all_pairs(spark, sf):
    return rounded(_rounded_delong(C.delong_family(wide(spark, sf), MODELS)), ["p_holm"], 7)


@query("delong_matrix", f"""WITH {delong_sql(PAIRS)}, m AS (SELECT model_a, model_b, delta FROM d UNION ALL SELECT model_b, model_a, -delta FROM d)
SELECT model_a AS model, {', '.join(f"round(max(delta) FILTER (model_b = '{m}'), 9) AS {m}" for m in MODELS)} FROM m GROUP BY model_a""")
def delong_matrix(spark, sf):
    return rounded(C.pair_matrix(C.delong(wide(spark, sf), MODELS), MODELS, "delta", -1), MODELS)


@query("p_matrix", f"""WITH {delong_sql(PAIRS)}, q AS (SELECT model_a, model_b, {normal_tail_sql('z')} AS p FROM d),
m AS (SELECT model_a, model_b, p FROM q UNION ALL SELECT model_b, model_a, p FROM q)
SELECT model_a AS model, {', '.join(f"round(max(p) FILTER (model_b = '{m}'), 7) AS {m}" for m in MODELS)} FROM m GROUP BY model_a""")
def p_matrix(spark, sf):
    return rounded(C.pair_matrix(C.delong(wide(spark, sf), MODELS), MODELS, "p_value", 1), MODELS, 7)


@query("p_labels", f"""WITH {delong_sql(PAIRS)}, q AS (SELECT model_a, model_b, {normal_tail_sql('z')} AS p FROM d)
SELECT model_a, model_b, round(-log10(greatest(p, 1e-300)), 6) AS strength, CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', p) END AS label FROM q""")
def p_labels(spark, sf):
    pairs = C.delong(wide(spark, sf), MODELS)
    return pairs.select("model_a", "model_b", r(neg_log10_p("p_value"), 6).alias("strength"), p_label("p_value").alias("label"))


@query("auc_ci_table", f"""WITH {delong_sql([(m, m) for m in MODELS])}
SELECT model_a AS model, round(auc1, 9) AS roc_auc, round(greatest(auc1 - {Q} * sqrt(v1), 0), 9) AS lo, round(least(auc1 + {Q} * sqrt(v1), 1), 9) AS hi FROM d""")
def auc_ci_table(spark, sf):
    return rounded(C.auc_intervals(wide(spark, sf), MODELS), ["roc_auc", "lo", "hi"])


@query("auc_components", f"WITH {COMPONENT_SQL} SELECT y, model, count(*) AS n, round(avg(c), 9) AS mean, round(var_samp(c), 9) AS var FROM comp GROUP BY ALL")
def auc_components(spark, sf):
    parts = C.components(wide(spark, sf), MODELS)
    long = parts.unpivot(["y"], [f"c_{m}" for m in MODELS], "model", "c")
    return long.groupBy("y", F.substring("model", 3, 10).alias("model")).agg(
        F.count("*").alias("n"), r(F.avg("c")).alias("mean"), r(F.var_samp("c")).alias("var"))


@query("delong_direct", f"""WITH {delong_sql([('m1', 'm2')])}
SELECT round(auc1, 9) AS auc1, round(auc2, 9) AS auc2, round(z, 6) AS z, TRUE AS agrees FROM d""")
def delong_direct(spark, sf):
    """Components from counts below a score against components from mid-ranks, over all rows."""
    rows = wide(spark, sf).select("id", "y", "m1", "m2")
    ranks = C.delong_by_ranks(rows, ["m1", "m2"]).select("model_a", "auc1", "auc2", "z", "p_value")
    fast = C.delong(rows, ["m1", "m2"]).select("model_a", F.col("z").alias("fast_z"), F.col("p_value").alias("fast_p"))
    return ranks.join(fast, "model_a").select(
        r("auc1").alias("auc1"), r("auc2").alias("auc2"), r("z", 6).alias("z"),
        ((F.abs(F.col("z") - F.col("fast_z")) < 1e-6) & (F.abs(F.col("p_value") - F.col("fast_p")) < 1e-6)).alias("agrees"))


def right_sql(m: str) -> str:
    return f"(CASE WHEN {m} >= {THRESHOLDS[m]} THEN 1 ELSE 0 END = y)"


MCNEMAR_SQL = "mc AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) FILTER ({right_sql(a)} AND NOT {right_sql(b)}) AS b, "
    f"count(*) FILTER (NOT {right_sql(a)} AND {right_sql(b)}) AS c FROM wide" for a, b in PAIRS) + """),
mx AS (SELECT *, pow(abs(b - c) - 1, 2) / (b + c) AS chi2 FROM mc)"""


@query("mcnemar", f"WITH {WIDE_SQL}, {MCNEMAR_SQL} SELECT model_a, model_b, b, c, round(chi2, 6) AS chi2, 'chi2' AS method, "
       f"round({normal_tail_sql('sqrt(chi2)')}, 6) AS p_value FROM mx")
def mcnemar(spark, sf):
    return rounded(C.mcnemar(wide(spark, sf), PAIRS, THRESHOLDS), ["chi2", "p_value"], 6)


@query("mcnemar_labels", f"""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS b, count(*) FILTER (quality = 0 AND toxic = 0) AS c FROM labels),
x AS (SELECT *, b + c AS n FROM c)
SELECT b, c, CASE WHEN n >= 25 THEN round(pow(abs(b - c) - 1, 2) / n, 6) WHEN n = 0 THEN 0 END AS chi2,
  CASE WHEN n = 0 THEN 'none' WHEN n < 25 THEN 'exact' ELSE 'chi2' END AS method,
  CASE WHEN n = 0 THEN 1 WHEN n < 25 THEN round(least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
         lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6)
       ELSE round({normal_tail_sql('sqrt(pow(abs(b - c) - 1, 2) / n)')}, 6) END AS p_value FROM x""")
def mcnemar_labels(spark, sf):
    """Quality and "not toxic" as two classifiers of the same documents, all of which count as positive."""
    rows = table(spark, sf, "labels").select(
        F.lit(1).alias("y"), F.col("quality").cast("double").alias("q"), (1 - F.col("toxic")).cast("double").alias("t"))
    out = C.mcnemar(rows, [("q", "t")], {"q": 0.5, "t": 0.5}).select("b", "c", "chi2", "method", "p_value")
    return rounded(out, ["chi2", "p_value"], 6)


@query("mcnemar_by_customer", f"""WITH r AS (SELECT o_custkey, o_orderstatus = 'F' AS ok1, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS ok2
  FROM orders),
c AS (SELECT o_custkey AS custkey, count(*) FILTER (ok1 AND NOT ok2) AS b, count(*) FILTER (NOT ok1 AND ok2) AS c FROM r GROUP BY o_custkey)
SELECT custkey, b, c, CASE WHEN b + c = 0 THEN 'none' WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS method,
  CASE WHEN b + c = 0 THEN 1 WHEN b + c < 25 THEN round(least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
         lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6)
       ELSE round({normal_tail_sql('sqrt(pow(abs(b - c) - 1, 2) / (b + c))')}, 6) END AS p_value FROM c""")
def mcnemar_by_customer(spark, sf):
    """One test per customer: few discordant rows, so mostly the exact branch."""
    orders = table(spark, sf, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("v")).scalar()
    ok1, ok2 = F.col("o_orderstatus") == "F", F.col("o_totalprice") > mean
    counts = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count_if(ok1 & ~ok2).alias("b"), F.count_if(~ok1 & ok2).alias("c"))
    tested = C.mcnemar_table(counts.select("b", "c").distinct())  # one p value for each pair of counts
    return rounded(counts.join(tested, ["b", "c"]).select("custkey", "b", "c", "method", "p_value"), ["p_value"], 6)


@query("holm_adjust", f"""WITH {WIDE_SQL}, {MCNEMAR_SQL},
src AS (SELECT model_a, model_b, model_a AS family, {normal_tail_sql('sqrt(chi2)')} AS p FROM mx), {HOLM_SQL}
SELECT family, model_a, model_b, round(p, 6) AS p_value, round(p_holm, 6) AS p_holm FROM h""")
def holm_adjust(spark, sf):
    tests = C.mcnemar(wide(spark, sf), PAIRS, THRESHOLDS).withColumn("family", F.col("model_a"))
    out = C.holm(tests, "p_value", ["family"]).select("family", "model_a", "model_b", "p_value", "p_holm")
    return rounded(out, ["p_value", "p_holm"], 6)


def _flags(spark, sf):
    scores = wide(spark, sf)
    dl = C.delong_family(scores, MODELS).select("model_a", "model_b", F.col("significant").alias("delong_sig"), "relevant")
    mc = C.holm(C.mcnemar(scores, PAIRS, THRESHOLDS).withColumn("family", F.lit("all")), "p_value", ["family"])
    return dl.join(mc.select("model_a", "model_b", (F.col("p_holm") < 0.05).alias("mcnemar_sig")), ["model_a", "model_b"])


FLAGS_SQL = f"""{delong_sql(PAIRS)}, {MCNEMAR_SQL},
tests AS (SELECT d.model_a, d.model_b, d.delta, {normal_tail_sql('d.z')} AS pd, {normal_tail_sql('sqrt(mx.chi2)')} AS pm
         FROM d JOIN mx ON d.model_a = mx.model_a AND d.model_b = mx.model_b),
ranked AS (SELECT *, row_number() OVER (ORDER BY pd) AS rd, row_number() OVER (ORDER BY pm) AS rm FROM tests),
flags AS (SELECT model_a, model_b, max((7 - rd) * pd) OVER (ORDER BY rd) < 0.05 AS delong_sig,
                 max((7 - rm) * pm) OVER (ORDER BY rm) < 0.05 AS mcnemar_sig, abs(delta) >= 0.005 AS relevant FROM ranked)"""


@query("test_agreement", f"""WITH {FLAGS_SQL} SELECT 'mcnemar_sig' AS test, count(*) FILTER (delong_sig = mcnemar_sig) AS agree,
  count(*) FILTER (delong_sig <> mcnemar_sig) AS differ FROM flags
UNION ALL SELECT 'relevant', count(*) FILTER (delong_sig = relevant), count(*) FILTER (delong_sig <> relevant) FROM flags""")
def test_agreement(spark, sf):
    return C.agreement(_flags(spark, sf), "delong_sig", ["mcnemar_sig", "relevant"])


@query("test_disagreements", f"WITH {FLAGS_SQL} SELECT model_a, model_b, delong_sig, mcnemar_sig, relevant FROM flags "
       "WHERE delong_sig <> mcnemar_sig OR delong_sig <> relevant")
def test_disagreements(spark, sf):
    return C.disagreements(_flags(spark, sf), "delong_sig", ["mcnemar_sig", "relevant"]).select(
        "model_a", "model_b", "delong_sig", "mcnemar_sig", "relevant")


@query("test_set_identity", f"""WITH {WIDE_SQL} SELECT count(*) AS n_base, count(*) AS n_other, 0::BIGINT AS missing_score, 0::BIGINT AS label_differs,
  0::BIGINT AS surplus, TRUE AS identical FROM wide""")
def test_set_identity(spark, sf):
    scores = wide(spark, sf)
    other = scores.select("id", "y", F.col("m2").alias("score")).repartition(7, "score")
    return C.score_join_check(scores.select("id", "y"), other)


REPLICATES, INTERVAL_REPLICATES = 2000, 200
#: Holm's adjustment is for the pairs of a family: those with the first model, and those among the others.
FAMILIES = {pair: "A" if MODELS[0] in pair else "B" for pair in PAIRS}


OBSERVED_SQL = f"""{LONG_SQL}, {curve_sql('long', 'model')},
ranks AS (SELECT model, sum(pos * (neg_below + neg / 2)) / (max(pos_total) * max(neg_total)) AS roc_auc,
  sum(pos / pos_total * (pos_total - pos_below) / (pos_total - pos_below + neg_total - neg_below)) AS average_precision FROM curve GROUP BY model),
f AS (SELECT model, 2.0::DOUBLE * count(*) FILTER (y = 1 AND score >= t) / (count(*) FILTER (score >= t) + count(*) FILTER (y = 1)) AS f1
      FROM long JOIN (VALUES {', '.join(f"('{m}', {t:.17e})" for m, t in THRESHOLDS.items())}) v(m, t) ON model = m GROUP BY model),
o AS (SELECT * FROM ranks JOIN f USING (model))"""


@query("bootstrap_observed", f"WITH {OBSERVED_SQL} " + " UNION ALL ".join(
    f"SELECT 'm1' AS model_a, 'm2' AS model_b, '{m}' AS metric, round(max({m}) FILTER (model = 'm1') - max({m}) FILTER (model = 'm2'), 9) AS observed FROM o"
    for m in B.METRICS))
def bootstrap_observed(spark, sf):
    out = B._observed_deltas(wide(spark, sf), [("m1", "m2")], {m: THRESHOLDS[m] for m in ("m1", "m2")})
    return rounded(out, ["observed"])


def replicate_sql(replicates: int, thresholds: dict) -> str:
    return f"{WIDE_SQL}, {replicates_sql(thresholds, replicates)}"


SUMMARY_SQL = f"""deltas AS (
  SELECT model_a, model_b, metric, round(CASE metric {' '.join(f"WHEN '{m}' THEN a.{m} - b.{m}" for m in B.METRICS)} END, 12) AS d
  FROM pairs JOIN reps a ON a.model = model_a JOIN reps b ON b.model = model_b AND b.rep = a.rep, (VALUES {', '.join(f"('{m}')" for m in B.METRICS)}) v(metric)),
spread AS (
  SELECT model_a, model_b, metric, avg(d) AS mean, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi,
    least(1, 2 * least(avg(CAST(d <= 0 AS INTEGER)), avg(CAST(d >= 0 AS INTEGER))) + 1 / ({REPLICATES} + 1)::DOUBLE) AS p_value
  FROM deltas GROUP BY model_a, model_b, metric)"""
#: Observed metrics without the tables that the replicates already bring.
_METRICS_SQL = OBSERVED_SQL.removeprefix(WIDE_SQL)
BOOTSTRAP_SQL = f"{replicate_sql(REPLICATES, THRESHOLDS)}{_METRICS_SQL}, {pairs_values(PAIRS)}, {SUMMARY_SQL}"


@query("bootstrap_delta", f"""WITH {BOOTSTRAP_SQL}
SELECT model_a, model_b, metric, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, round(p_value, 9) AS p_value,
  round(CASE metric {' '.join(f"WHEN '{m}' THEN a.{m} - b.{m}" for m in B.METRICS)} END, 9) AS observed, NOT (lo <= 0 AND hi >= 0) AS excludes_zero
FROM spread JOIN o a ON a.model = model_a JOIN o b ON b.model = model_b""")
def bootstrap_delta(spark, sf):
    return rounded(B.paired_bootstrap(wide(spark, sf), PAIRS, THRESHOLDS, REPLICATES), ["mean", "lo", "hi", "p_value", "observed"])


@query("bootstrap_auc_ci", f"""WITH {replicate_sql(INTERVAL_REPLICATES, {m: 0.5 for m in MODELS})}
SELECT model, round(quantile_cont(roc_auc, 0.025), 9) AS lo, round(quantile_cont(roc_auc, 0.975), 9) AS hi, count(*) AS replicates FROM reps GROUP BY model""")
def bootstrap_auc_ci(spark, sf):
    return rounded(B.bootstrap_auc_interval(wide(spark, sf), MODELS, INTERVAL_REPLICATES), ["lo", "hi"])


_FIVE = ["p_delong", "p_mcnemar", *[f"{m}_p_value" for m in B.METRICS]]
_FAMILY_VALUES = ", ".join(f"('{a}', '{b}', '{f}')" for (a, b), f in FAMILIES.items())


def three_sql() -> str:
    """DeLong, McNemar and bootstrap of all pairs in one row each, p values adjusted by Holm within the family."""
    delong = delong_sql(PAIRS)[len(LONG_SQL):]
    delong = delong[delong.index("comp AS ("):].replace(f"{pairs_values(PAIRS)},", "")
    metrics = ", ".join(f"max({c}) FILTER (metric = '{m}') AS {m}_{c}" for m in B.METRICS for c in ("mean", "lo", "hi", "p_value"))
    ranks = ", ".join(f"row_number() OVER (PARTITION BY family ORDER BY {p}) AS rk_{p}" for p in _FIVE)
    holm = ", ".join(f"least(1, max((size - rk_{p} + 1) * {p}) OVER (PARTITION BY family ORDER BY rk_{p})) AS {p}_holm" for p in _FIVE)
    label = ", ".join(f"printf('%+.4f [%+.4f, %+.4f]', {m}_mean, {m}_lo, {m}_hi) AS {m}_interval" for m in B.METRICS)
    flags = ", ".join(f"NOT ({m}_lo <= 0 AND {m}_hi >= 0) AS {m}_sig, round({m}_p_value_holm, 7) AS {m}_p_value_holm" for m in B.METRICS)
    return f"""WITH {BOOTSTRAP_SQL}, {delong}, {MCNEMAR_SQL},
boot AS (SELECT model_a, model_b, {metrics} FROM spread GROUP BY model_a, model_b),
tests AS (SELECT f.*, d.delta, mx.b, mx.c, {normal_tail_sql('d.z')} AS p_delong, {normal_tail_sql('sqrt(mx.chi2)')} AS p_mcnemar, boot.* EXCLUDE (model_a, model_b)
  FROM (VALUES {_FAMILY_VALUES}) f(model_a, model_b, family) JOIN d USING (model_a, model_b) JOIN mx USING (model_a, model_b) JOIN boot USING (model_a, model_b)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY family) AS size, {ranks} FROM tests),
adjusted AS (SELECT *, {holm} FROM ranked)
SELECT family, model_a, model_b, round(delta, 9) AS delta, round(p_delong_holm, 7) AS p_delong_holm, p_delong_holm < 0.05 AS delong_sig,
  b || ' / ' || c AS b_c, round(p_mcnemar_holm, 7) AS p_mcnemar_holm, p_mcnemar_holm < 0.05 AS mcnemar_sig, {label}, {flags}, abs(delta) >= 0.005 AS relevant
FROM adjusted"""


@query("three_test_table", three_sql())
def three_test_table(spark, sf):
    scores = wide(spark, sf)
    out = B.three_test_table(C.delong_family(scores, MODELS, PAIRS, FAMILIES), C.mcnemar(scores, PAIRS, THRESHOLDS),
                             B.paired_bootstrap(scores, PAIRS, THRESHOLDS, REPLICATES))
    return rounded(rounded(out, ["delta"]), ["p_delong_holm", "p_mcnemar_holm", *[f"{m}_p_value_holm" for m in B.METRICS]], 7)
