"""Ranking and threshold metrics on the score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import metrics as M
from rankfold.operators import report as R
from rankfold.operators.ordering import midranks, midranks_of
from rankfold.plans.catalog import (AP_SQL, AUC_SQL, LONG_SQL, MODELS, THRESHOLDS, VARIANTS_SQL, WIDE_SQL, curve_sql, long,
                                    number_sql, query, r, rounded, variants, wide)

RATES = ["accuracy", "balanced_acc", "precision", "recall", "specificity", "f1", "mcc"]
RATES_SQL = """round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced_acc,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
  round(tn / nullif(tn + fp, 0), 9) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn)) * sqrt((tn + fp) * (tn + fn)), 0), 0), 9) AS mcc"""


def counts_sql(thr: str) -> str:
    return f"""count(*) FILTER (score < {thr} AND y = 0) AS tn, count(*) FILTER (score >= {thr} AND y = 0) AS fp,
  count(*) FILTER (score < {thr} AND y = 1) AS fn, count(*) FILTER (score >= {thr} AND y = 1) AS tp"""


@query("threshold_metrics", f"""WITH {LONG_SQL}, c AS (SELECT model, {counts_sql('0.5')} FROM long GROUP BY model)
SELECT model, tn, fp, fn, tp, {RATES_SQL} FROM c""")
def threshold_metrics(spark, sf):
    return rounded(M.threshold_metrics(long(spark, sf), 0.5, ["model"]), RATES)


@query("auc_by_score", f"WITH {LONG_SQL}, {curve_sql('long', 'model')} SELECT model, round({AUC_SQL}, 9) AS roc_auc FROM curve GROUP BY model")
def auc_by_score(spark, sf):
    return rounded(M.auc(long(spark, sf), ["model"]), ["roc_auc"])


@query("average_precision", f"WITH {LONG_SQL}, {curve_sql('long', 'model')} "
       f"SELECT model, round({AP_SQL}, 9) AS average_precision FROM curve GROUP BY model")
def average_precision(spark, sf):
    return rounded(M.ranking_metrics(long(spark, sf), ["model"]), ["average_precision"]).select("model", "average_precision")


@query("brier", f"WITH {LONG_SQL} SELECT model, round(avg((score - y) * (score - y)), 9) AS brier FROM long GROUP BY model")
def brier(spark, sf):
    return rounded(M.brier(long(spark, sf), ["model"]), ["brier"])


@query("roc_points", f"""WITH {LONG_SQL}, {curve_sql('long', 'model')}
SELECT model, score AS threshold, round((neg_total - neg_below) / neg_total, 9) AS fpr,
       round((pos_total - pos_below) / pos_total, 9) AS tpr FROM curve
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM long""")
def roc_points(spark, sf):
    return rounded(M.roc_points(long(spark, sf), ["model"]), ["fpr", "tpr"])


@query("pr_points", f"""WITH {LONG_SQL}, {curve_sql('long', 'model')}
SELECT model, score AS threshold, round((pos_total - pos_below) / (pos_total - pos_below + neg_total - neg_below), 9) AS precision,
       round((pos_total - pos_below) / pos_total, 9) AS recall FROM curve
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM long""")
def pr_points(spark, sf):
    return rounded(M.pr_points(long(spark, sf), ["model"]), ["precision", "recall"])


def grid_sql(grid: list[float]) -> str:
    return f"""grid AS (SELECT unnest({number_sql(grid)}) AS threshold),
counts AS (SELECT model, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp,
                  count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (y = 1) AS pos
           FROM long CROSS JOIN grid GROUP BY model, threshold)"""


@query("multi_threshold_counts", f"WITH {LONG_SQL}, {grid_sql(M.GRID_99)} SELECT model, threshold, tp, fp, pos FROM counts")
def multi_threshold_counts(spark, sf):
    return M.multi_threshold_counts(long(spark, sf), ["model"], M.GRID_99)


BEST_SQL = """best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn FROM (
  SELECT model, threshold, CAST(2 * tp AS DOUBLE) / greatest(2 * tp + fp + (pos - tp), 1) AS f1 FROM counts))
SELECT model, {threshold} AS threshold, round(f1, 9) AS f1 FROM best WHERE rn = 1"""


@query("best_f1_threshold", f"WITH {LONG_SQL}, {grid_sql(M.GRID_199)}, {BEST_SQL.format(threshold='round(threshold, 9)')}")
def best_f1_threshold(spark, sf):
    return rounded(M.best_f1_threshold(long(spark, sf), ["model"]), ["threshold", "f1"])


MARGIN_SQL = f"""{WIDE_SQL}, margins AS (SELECT y, 'm1' AS model, 4 * m1 - 2 AS score FROM wide
  UNION ALL SELECT y, 'm2', 4 * m2 - 2 FROM wide),
long AS (SELECT * FROM margins),
probs AS (SELECT unnest({number_sql(M.GRID_199)}) AS prob),
ordered AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) - 1 AS pos,
                   count(*) OVER (PARTITION BY model) - 1 AS last FROM margins),
wanted AS (SELECT DISTINCT model, prob, prob * last AS spot FROM (SELECT DISTINCT model, last FROM ordered) CROSS JOIN probs),
grid AS (SELECT DISTINCT w.model, lo.score + (hi.score - lo.score) * (spot - floor(spot)) AS threshold
         FROM wanted w JOIN ordered lo ON lo.model = w.model AND lo.pos = floor(spot)
         JOIN ordered hi ON hi.model = w.model AND hi.pos = ceil(spot)),
counts AS (SELECT long.model, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp,
                  count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (y = 1) AS pos
           FROM long JOIN grid ON long.model = grid.model GROUP BY long.model, threshold)"""


@query("margin_f1_threshold", f"WITH {MARGIN_SQL}, {BEST_SQL.format(threshold='round(threshold, 9)')}")
def margin_f1_threshold(spark, sf):
    margins = wide(spark, sf).select("y", (4 * F.col("m1") - 2).alias("m1"), (4 * F.col("m2") - 2).alias("m2")).unpivot(
        ["y"], ["m1", "m2"], "model", "score")
    return rounded(M.best_f1_threshold(margins, ["model"]), ["threshold", "f1"])


POINTS = [(m, "default", 0.5) for m in MODELS] + [(m, "chosen", t) for m, t in THRESHOLDS.items()]
POINTS_SQL = "points AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{p}', {t:.17e})" for m, p, t in POINTS) + \
    ") t(model, point, threshold))"


@query("model_metric_table", f"""WITH {LONG_SQL}, {POINTS_SQL}, {curve_sql('long', 'model')},
ranks AS (SELECT model, round({AUC_SQL}, 9) AS roc_auc, round({AP_SQL}, 9) AS average_precision FROM curve GROUP BY model),
c AS (SELECT long.model, point, threshold, {counts_sql('threshold')} FROM long JOIN points ON long.model = points.model
      GROUP BY long.model, point, threshold)
SELECT c.model, point, threshold, tn, fp, fn, tp, {RATES_SQL}, roc_auc, average_precision FROM c JOIN ranks ON c.model = ranks.model""")
def model_metric_table(spark, sf):
    points = spark.createDataFrame(POINTS, "model string, point string, threshold double")
    return rounded(M.operating_points(long(spark, sf), points, ["model"]), [*RATES, "roc_auc", "average_precision"])


def _engine_metrics(spark, sf):
    scores = variants(spark, sf)
    by = ["engine", "model"]
    counts = M.threshold_metrics(scores, 0.5, by).select(*by, "accuracy", "precision", "recall", "f1")
    return M.ranking_metrics(scores, by).select(*by, "roc_auc", "average_precision").join(counts, by)


ENGINE_SQL = f"""{VARIANTS_SQL}, {curve_sql('variants', 'engine, model')},
ranks AS (SELECT engine, model, {AUC_SQL} AS roc_auc, {AP_SQL} AS average_precision FROM curve GROUP BY engine, model),
c AS (SELECT engine, model, {counts_sql('0.5')} FROM variants GROUP BY engine, model),
e AS (SELECT engine, model, roc_auc, average_precision, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
             coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c JOIN ranks USING (engine, model))"""
ENGINE_METRICS = ["roc_auc", "average_precision", "accuracy", "precision", "recall", "f1"]


@query("metric_comparison", f"WITH {ENGINE_SQL} SELECT engine, model, {', '.join(f'round({m}, 9) AS {m}' for m in ENGINE_METRICS)} FROM e")
def metric_comparison(spark, sf):
    return rounded(_engine_metrics(spark, sf), ENGINE_METRICS)


@query("metric_pivot", f"WITH {ENGINE_SQL} SELECT model, " + ", ".join(
    f"round(max({m}) FILTER (engine = '{v}'), 9) AS {v}_{m}" for v in ("fine", "coarse") for m in ("roc_auc", "f1")) + " FROM e GROUP BY model")
def metric_pivot(spark, sf):
    out = R.metric_pivot(_engine_metrics(spark, sf), "model", "engine", ["fine", "coarse"], ["roc_auc", "f1"])
    return rounded(out, [c for c in out.columns if c != "model"])


@query("top2_per_group", f"""WITH {ENGINE_SQL} SELECT engine, model, round(roc_auc, 9) AS roc_auc, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY engine ORDER BY roc_auc DESC, model) AS INTEGER) AS position FROM e) WHERE position <= 2""")
def top2_per_group(spark, sf):
    table = R.top_per_group(_engine_metrics(spark, sf), "engine", "roc_auc", "model", 2)
    return rounded(table, ["roc_auc"]).select("engine", "model", "roc_auc", "position")


@query("best_eligible", f"""WITH {ENGINE_SQL} SELECT engine, model, round(roc_auc, 9) AS roc_auc FROM e
WHERE engine = 'fine' AND model <> 'm3' ORDER BY e.roc_auc DESC, model LIMIT 1""")
def best_eligible(spark, sf):
    best = R.best_eligible(_engine_metrics(spark, sf), (F.col("engine") == "fine") & (F.col("model") != "m3"), "roc_auc", "model")
    return rounded(best, ["roc_auc"]).select("engine", "model", "roc_auc")


@query("metric_rollup_total", f"""WITH {VARIANTS_SQL}, t AS (
  SELECT model, CAST(sum(CASE WHEN engine = 'fine' THEN y * (score >= 0.5)::INTEGER ELSE 0 END) AS DOUBLE) AS fine,
         CAST(sum(CASE WHEN engine = 'coarse' THEN y * (score >= 0.5)::INTEGER ELSE 0 END) AS DOUBLE) AS coarse FROM variants GROUP BY model)
SELECT coalesce(model, 'TOTAL') AS model, sum(fine) AS fine, sum(coarse) AS coarse,
       round(sum(coarse) / nullif(sum(fine), 0), 9) AS ratio FROM t GROUP BY ROLLUP (model)""")
def metric_rollup_total(spark, sf):
    hits = variants(spark, sf).withColumn("hit", F.col("y") * (F.col("score") >= 0.5).cast("int"))
    per_model = hits.groupBy("model").pivot("engine", ["fine", "coarse"]).agg(F.sum("hit").cast("double"))
    return rounded(R.totals_and_ratio(per_model, "model", "fine", "coarse"), ["ratio"])


RANK_SQL = """(rank() OVER (PARTITION BY model ORDER BY score)
  + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0)"""


@query("midrank", f"WITH {LONG_SQL} SELECT id, model, score, CAST({RANK_SQL} AS DOUBLE) AS midrank FROM long")
def midrank(spark, sf):
    return midranks(long(spark, sf), ["model"], "score").select("id", "model", "score", "midrank")


@query("midrank_within_class", f"""WITH {LONG_SQL} SELECT id, model, y, CAST((rank() OVER (PARTITION BY model, y ORDER BY score)
  + (count(*) OVER (PARTITION BY model, y, score) - 1) / 2.0) AS DOUBLE) AS midrank FROM long""")
def midrank_within_class(spark, sf):
    return midranks(long(spark, sf), ["model", "y"], "score").select("id", "model", "y", "midrank")


@query("pct_midrank", f"""WITH {LONG_SQL} SELECT id, model, round(CAST({RANK_SQL} AS DOUBLE) / count(*) OVER (PARTITION BY model), 9) AS pct
FROM long""")
def pct_midrank(spark, sf):
    return midranks(long(spark, sf), ["model"], "score", percent="pct").select("id", "model", r("pct").alias("pct"))


@query("cumulative_counts", f"""WITH {LONG_SQL}, {curve_sql('long', 'model')}
SELECT model, score, CAST(pos_total - pos_below AS BIGINT) AS tp, CAST(neg_total - neg_below AS BIGINT) AS fp FROM curve""")
def cumulative_counts(spark, sf):
    table = M.score_distribution(long(spark, sf), ["model"]).table
    return table.select("model", "score", (F.col("pos_total") - F.col("pos_below")).alias("tp"),
                        (F.col("neg_total") - F.col("neg_below")).alias("fp"))


@query("joint_percentile_topk", f"""WITH {LONG_SQL},
ranked AS (SELECT id, y, model, score, CAST({RANK_SQL} AS DOUBLE) / count(*) OVER (PARTITION BY model) AS pct FROM long),
joined AS (SELECT a.id, a.y, a.score AS p1, b.score AS p2, a.pct + b.pct AS pct FROM ranked a JOIN ranked b ON a.id = b.id
           WHERE a.model = 'm1' AND b.model = 'm2')
SELECT * FROM (SELECT 'FN' AS kind, id, p1, p2, round(pct, 9) AS pct FROM joined WHERE y = 1 AND p1 < 0.5 AND p2 < 0.45 ORDER BY joined.pct, id LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'FP' AS kind, id, p1, p2, round(pct, 9) AS pct FROM joined WHERE y = 0 AND p1 >= 0.5 AND p2 >= 0.45 ORDER BY joined.pct DESC, id LIMIT 1)""")
def joint_percentile_topk(spark, sf):
    scores = wide(spark, sf)
    ranked = midranks_of(scores.select("id", "y", F.col("m1").alias("p1"), F.col("m2").alias("p2")), "id", ["p1", "p2"], ("y",))
    joined = ranked.withColumn("pct", F.col("p1_pct") + F.col("p2_pct"))
    return rounded(R.joint_extremes(joined, "p1", "p2", THRESHOLDS["m1"], THRESHOLDS["m2"]), ["pct"]).select("kind", "id", "p1", "p2", "pct")


@query("score_dispersion", f"""WITH {LONG_SQL} SELECT model, round(stddev_pop(score), 9) AS sd, min(score) AS min, max(score) AS max, count(DISTINCT score) AS n_distinct,
  stddev_pop(score) < 1e-9 AS degenerate FROM long GROUP BY model""")
def score_dispersion(spark, sf):
    return rounded(M.score_dispersion(long(spark, sf), ["model"]), ["sd"])


@query("overfit_gap", f"""WITH {VARIANTS_SQL}, {curve_sql('variants', 'engine, model')},
a AS (SELECT engine, model, {AUC_SQL} AS roc_auc FROM curve GROUP BY engine, model)
SELECT f.model, round(f.roc_auc, 9) AS auc_train, round(c.roc_auc, 9) AS auc_cv, round(f.roc_auc - c.roc_auc, 9) AS gap
FROM a f JOIN a c ON f.model = c.model WHERE f.engine = 'fine' AND c.engine = 'coarse'""")
def overfit_gap(spark, sf):
    table = M.auc(variants(spark, sf), ["engine", "model"])
    gap = M.overfit_gap(table.filter("engine = 'fine'"), table.filter("engine = 'coarse'"), ["model"])
    return rounded(gap, ["auc_train", "auc_cv", "gap"])
