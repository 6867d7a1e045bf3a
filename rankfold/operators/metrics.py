"""Ranking and threshold metrics of score tables `(id, y, score)`, grouped by any columns.

All functions take a long score table and a list of group columns (model, engine, source
column, replicate ...) and return one small DataFrame.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankfold.functions.scalars import ratio, ratio_or_zero
from rankfold.operators.ordering import Distribution, distribution, exact_quantiles


def evenly_spaced(low: float, high: float, n: int, digits: int | None = None) -> list[float]:
    step = (high - low) / (n - 1)
    points = [low + i * step for i in range(n - 1)] + [high]
    return [round(p, digits) for p in points] if digits is not None else points


GRID_99 = evenly_spaced(0.02, 0.98, 99, digits=4)
GRID_199 = evenly_spaced(0.02, 0.98, 199)


def score_distribution(scores: DataFrame, by: list[str], score: str = "score", y: str = "y", **kw) -> Distribution:
    """Positives and negatives per distinct score, with counts below; feeds every ranking metric."""
    positive = F.col(y).cast("long")
    return distribution(scores, by, score, {"pos": positive, "neg": 1 - positive}, **kw)


def _auc(found: Distribution) -> Column:
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0))
    return ratio(wins, F.first("pos_total").cast("double") * F.first("neg_total"))


def _average_precision() -> Column:
    at_or_above_pos = F.col("pos_total") - F.col("pos_below")
    at_or_above_neg = F.col("neg_total") - F.col("neg_below")
    step = ratio("pos", "pos_total") * at_or_above_pos / (at_or_above_pos + at_or_above_neg)
    return F.sum(F.when(F.col("pos") > 0, step).otherwise(0.0))


def ranking_metrics(scores: DataFrame, by: list[str], score: str = "score", y: str = "y",
                    found: Distribution | None = None) -> DataFrame:
    """Exact ROC AUC (ties count one half) and step-wise average precision."""
    found = found or score_distribution(scores, by, score, y)
    return found.table.groupBy(*by).agg(_auc(found).alias("roc_auc"), _average_precision().alias("average_precision"),
                                        F.first("pos_total").alias("n_pos"), F.first("neg_total").alias("n_neg"))


def auc(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    return ranking_metrics(scores, by, score, y).select(*by, "roc_auc")


def brier(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg((F.col(score) - F.col(y)) ** 2).alias("brier"))


def roc_points(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """One `(threshold, fpr, tpr)` per distinct score, plus the origin with a null threshold."""
    table = score_distribution(scores, by, score, y).table
    curve = table.select(
        *by, F.col(score).alias("threshold"),
        ratio(F.col("neg_total") - F.col("neg_below"), "neg_total").alias("fpr"),
        ratio(F.col("pos_total") - F.col("pos_below"), "pos_total").alias("tpr"))
    origin = scores.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)


def pr_points(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """One `(threshold, precision, recall)` per distinct score, plus the end point (1, 0)."""
    table = score_distribution(scores, by, score, y).table
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    curve = table.select(*by, F.col(score).alias("threshold"), ratio(tp, tp + fp).alias("precision"),
                         ratio(tp, "pos_total").alias("recall"))
    end = scores.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def confusion(scores: DataFrame, by: list[str], threshold: Column, score: str = "score", y: str = "y") -> DataFrame:
    """Counts at `score >= threshold`; the threshold is a literal or a column of the table."""
    flagged, positive = F.col(score) >= threshold, F.col(y) == 1
    return scores.groupBy(*by).agg(
        F.count_if(~flagged & ~positive).alias("tn"), F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"), F.count_if(flagged & positive).alias("tp"))


def with_threshold_metrics(counts: DataFrame) -> DataFrame:
    """Metrics from columns tn, fp, fn, tp; zero denominators give 0, null for specificity."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    specificity = ratio(tn, tn + fp)
    recall = ratio_or_zero(tp, tp + fn)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, n),
        # Mean over the classes that occur.
        "balanced_acc": (F.coalesce(ratio(tp, tp + fn), specificity) + F.coalesce(specificity, ratio(tp, tp + fn))) / 2,
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        # The product of the four margins as two square roots keeps it finite for huge counts.
        "mcc": ratio_or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn))),
    })


def threshold_metrics(scores: DataFrame, threshold: float | Column, by: list[str] | None = None,
                      score: str = "score", y: str = "y") -> DataFrame:
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return with_threshold_metrics(confusion(scores, by or [], cut, score, y))


def multi_threshold_counts(scores: DataFrame, by: list[str], grid: list[float], score: str = "score",
                           y: str = "y") -> DataFrame:
    """`(threshold, tp, fp, pos)` for every grid point, in one pass over the scores.

    Each score is placed among the grid points by binary search; the reverse running sum
    then works on at most len(grid)+1 rows per group.
    """
    points = sorted(set(float(g) for g in grid))
    placed = Bucketizer(splits=[float("-inf"), *points, float("inf")], inputCol="_s", outputCol="_at").transform(
        scores.filter(F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("_s"),
                                                       F.col(y).cast("long").alias("_y")))
    cells = placed.groupBy(*by, F.col("_at").cast("int").alias("_at")).agg(
        F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    # Grid points nobody fell on still need a row.
    steps = scores.select(*by).distinct().withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(points)))))
    full = steps.join(cells, [*by, "_at"], "left").fillna(0, ["_pos", "_neg"])
    above = W.partitionBy(*by).orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    return full.select(
        *by, "_at", F.sum("_pos").over(above).alias("tp"), F.sum("_neg").over(above).alias("fp"),
        F.sum("_pos").over(whole).alias("pos"),
    ).filter(F.col("_at") > 0).select(*by, F.element_at(F.array(*[F.lit(p) for p in points]), F.col("_at")).alias("threshold"),
                                      "tp", "fp", "pos")


def with_search_f1(counts: DataFrame) -> DataFrame:
    """F1 from tp, fp, pos with the denominator floored at 1."""
    tp = F.col("tp").cast("double")
    return counts.withColumn("f1", 2 * tp / F.greatest(2 * tp + F.col("fp") + (F.col("pos") - tp), F.lit(1.0)))


def first_best(table: DataFrame, by: list[str], metric: str, tie: str) -> DataFrame:
    """Row with the largest metric per group; ties go to the smallest `tie`."""
    others = [c for c in table.columns if c not in by]
    best = F.max_by(F.struct(*others), F.struct(F.col(metric), -F.col(tie))).alias("_b")
    return table.groupBy(*by).agg(best).select(*by, *[F.col(f"_b.{c}").alias(c) for c in others])


def best_f1_threshold(scores: DataFrame, by: list[str], score: str = "score", y: str = "y",
                      grid: list[float] | None = None, points: int = 199) -> DataFrame:
    """Grid threshold with the largest F1, first one on ties: `(threshold, f1)` per group.

    Without a grid, scores inside [0, 1] use `points` steps from 0.02 to 0.98; groups whose
    scores leave [0, 1] use quantiles of their own scores at those probabilities.
    """
    if grid is not None:
        table = multi_threshold_counts(scores, by, grid, score, y)
        return first_best(with_search_f1(table), by, "f1", "threshold").select(*by, "threshold", "f1")
    steps = evenly_spaced(0.02, 0.98, points)
    kinds = scores.groupBy(*by).agg(((F.min(score) >= 0) & (F.max(score) <= 1)).alias("_probability"))
    tables = multi_threshold_counts(scores, by, steps, score, y)
    margins = kinds.filter(~F.col("_probability")).drop("_probability")
    if margins.isEmpty():
        pass
    elif not by:
        tables = _quantile_counts(scores, by, steps, score, y)
    else:
        probability = kinds.filter("_probability").drop("_probability")
        inside, outside = _restrict(scores, probability, by), _restrict(scores, margins, by)
        tables = multi_threshold_counts(inside, by, steps, score, y).unionByName(
            _quantile_counts(outside, by, steps, score, y))
    return first_best(with_search_f1(tables), by, "f1", "threshold").select(*by, "threshold", "f1")


def _restrict(scores: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    # One row per model, so the broadcast is bounded by the model list.
    return scores.join(F.broadcast(groups), by, "left_semi")


def _quantile_counts(scores: DataFrame, by: list[str], steps: list[float], score: str, y: str) -> DataFrame:
    """tp, fp, pos at quantile thresholds of each group, from the score distribution."""
    positive = F.col(y).cast("long")
    found = distribution(scores, by, score, {"pos": positive, "neg": 1 - positive, "n": F.lit(1)})
    grid = exact_quantiles(scores, by, score, steps, found).select(*by, F.col("quantile").alias("threshold")).distinct()
    # Quantiles and scores in one ordered table: scores of a model are few enough rows per
    # threshold interval once each score is placed between thresholds.
    bounds = grid.groupBy(*by).agg(F.sort_array(F.collect_set("threshold")).alias("_grid"))
    placed = (found.table.join(F.broadcast(bounds), by) if by else
              found.table.withColumn("_k", F.lit(1)).join(F.broadcast(bounds.withColumn("_k", F.lit(1))), "_k"))
    cells = placed.select(*by, "_grid", "pos", "neg", "pos_total",
                          F.size(F.filter("_grid", lambda g: g <= F.col(score))).alias("_at"))
    sums = cells.groupBy(*by, "_at").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    steps_table = bounds.select(*by, F.posexplode("_grid").alias("_i", "threshold")).withColumn("_at", F.col("_i") + 1)
    full = steps_table.join(sums, [*by, "_at"], "left").fillna(0, ["_pos", "_neg"])
    above = W.partitionBy(*by).orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)
    totals = found.table.groupBy(*by).agg(F.first("pos_total").alias("pos"))
    out = full.select(*by, "threshold", F.sum("_pos").over(above).alias("tp"), F.sum("_neg").over(above).alias("fp"))
    joined = (out.join(F.broadcast(totals), by) if by else
              out.withColumn("_k", F.lit(1)).join(F.broadcast(totals.withColumn("_k", F.lit(1))), "_k"))
    return joined.select(*by, "threshold", "tp", "fp", "pos")


def operating_points(scores: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score",
                     y: str = "y") -> DataFrame:
    """All metrics of every model at every operating point.

    `thresholds` is `(*by, point, threshold)`: models x points rows, bounded by the model list.
    """
    paired = scores.join(F.broadcast(thresholds), by)
    counts = confusion(paired, [*by, "point", "threshold"], F.col("threshold"), score, y)
    ranks = ranking_metrics(scores, by, score, y).select(*by, "roc_auc", "average_precision")
    return with_threshold_metrics(counts).join(ranks, by)


def score_dispersion(scores: DataFrame, by: list[str], score: str = "score", tolerance: float = 1e-9) -> DataFrame:
    """Spread of each score column; `degenerate` marks an almost constant score."""
    return scores.groupBy(*by).agg(
        F.stddev_pop(score).alias("sd"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.count_distinct(score).alias("n_distinct"),
    ).withColumn("degenerate", F.col("sd") < tolerance)


def overfit_gap(train_auc: DataFrame, cv_auc: DataFrame, by: list[str]) -> DataFrame:
    """Training AUC minus cross-validated AUC per model."""
    return (train_auc.select(*by, F.col("roc_auc").alias("auc_train"))
            .join(cv_auc.select(*by, F.col("roc_auc").alias("auc_cv")), by)
            .withColumn("gap", F.col("auc_train") - F.col("auc_cv")))
