"""Bootstrap of ranking metrics, exact and spread over the cluster.

A replicate draws N rows with replacement. Drawing B x N rows and shuffling them is the
naive form; a replicate is a weight per row instead. By default the weights are those of `counterboot`, which nothing
has to shuffle. `weights="multinomial"` keeps the total of every replicate at N:

1. rows lie in hash buckets; for each replicate a multinomial draw says how many of its N
   draws each bucket gets (buckets x replicates numbers), and inside a bucket those draws
   pick rows uniformly - together exactly a multinomial draw over all rows;
2. inside the bucket task, rows with equal score are merged, so a score held by a third of
   all rows leaves a bucket as one row carrying its weights for all replicates of a batch;
3. merged rows are ranged by score. One pass gives positives and negatives per range and
   replicate, their running sums give each range its start, and a second pass adds up the
   metric inside the range.

All random numbers are seeded by (seed, replicate, bucket), so reruns give equal weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from rankfold.functions.scalars import ratio, ratio_or_zero
from rankfold.operators.counterboot import counter_replicates
from rankfold.operators.metrics import ranking_metrics, threshold_metrics
from rankfold.session import materialize

MAX_BUCKETS = 65_536
MAX_RANGES = 16_384
#: Weights (rows x replicates) one task holds at a time.
TASK_WEIGHTS = 4_000_000


def _rows_to_matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.int32) for b in column]).astype(np.int64)


def _merge_equal(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray):
    """Sum weight rows of equal scores; scores come back in descending order."""
    order = np.argsort(-scores, kind="stable")
    ordered = scores[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.add.reduceat(pos[order], starts, axis=0), np.add.reduceat(neg[order], starts, axis=0)


def _bucket_draws(spark, sizes: list[int], replicates: range, seed: int) -> DataFrame:
    """`(_bucket, rep, k)`: draws of every replicate that fall in every bucket."""
    counts = np.asarray(sizes, dtype=np.int64)
    total = int(counts.sum())

    def draw(batches):
        for batch in batches:
            for rep in batch["rep"]:
                k = np.random.default_rng([seed, int(rep)]).multinomial(total, counts / total)
                yield pd.DataFrame({"_bucket": np.arange(len(k), dtype=np.int32), "rep": np.int32(rep), "k": k})

    reps = spark.range(replicates.start, replicates.stop).select(F.col("id").cast("int").alias("rep"))
    return reps.mapInPandas(draw, "_bucket int, rep int, k long")


def _weighted_scores(rows: DataFrame, draws: DataFrame, models: list[str], seed: int) -> DataFrame:
    """`(model, score, pos, neg)` with one int32 weight per replicate packed in pos and neg."""

    def one_bucket(key: tuple, mine: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"model": [], "score": [], "pos": [], "neg": []})
        if mine.empty or drawn.empty:
            return empty
        mine = mine.sort_values("_id", kind="stable")
        drawn = drawn.sort_values("rep")
        n = len(mine)
        weights = np.empty((n, len(drawn)), dtype=np.int32)
        for j, (rep, k) in enumerate(zip(drawn["rep"], drawn["k"])):
            rng = np.random.default_rng([seed, int(rep), int(key[0]), 1])
            weights[:, j] = np.bincount(rng.integers(0, n, k), minlength=n)
        positive = mine["y"].to_numpy()[:, None] == 1
        pos, neg = np.where(positive, weights, 0), np.where(positive, 0, weights)
        out = []
        for model in models:
            values, p, q = _merge_equal(mine[model].to_numpy(dtype=float), pos, neg)
            out.append(pd.DataFrame({"model": model, "score": values,
                                     "pos": [r.tobytes() for r in p.astype(np.int32)],
                                     "neg": [r.tobytes() for r in q.astype(np.int32)]}))
        return pd.concat(out)

    return rows.groupBy("_bucket").cogroup(draws.groupBy("_bucket")).applyInPandas(
        one_bucket, "model string, score double, pos binary, neg binary")


def _range_column(rows: DataFrame, models: list[str], ranges: int):
    """Range number of a score; higher scores have higher numbers. Cuts steer balance only."""
    if ranges <= 1:
        return F.lit(0)
    probabilities = [i / ranges for i in range(1, ranges)]
    found = rows.approxQuantile(models, probabilities, 0.25 / ranges)
    cuts = {m: np.array(sorted(set(c))) for m, c in zip(models, found)}

    @F.pandas_udf("int")
    def place(model: pd.Series, score: pd.Series) -> pd.Series:
        out = np.zeros(len(model), dtype=np.int32)
        for m, bounds in cuts.items():
            mine = (model == m).to_numpy()
            out[mine] = np.searchsorted(bounds, score.to_numpy()[mine], side="right")
        return pd.Series(out)

    return place("model", "score")


def replicate_metrics(wide: DataFrame, thresholds: dict[str, float], replicates: int, seed: int = 42,
                      id_column: str = "id", weights: str = "counter", bucket_rows: int = 20_000,
                      batch: int = 200) -> DataFrame:
    """`(rep, model, roc_auc, average_precision, f1)`, equal row weights for all models of a replicate.

    `weights="counter"` draws Poisson(1) weights by (seed, replicate, id); "multinomial" draws a fixed total of N.
    """
    if weights == "counter":
        return counter_replicates(wide, thresholds, replicates, seed, id_column)
    models = list(thresholds)
    spark = wide.sparkSession
    n = wide.count()
    buckets = max(1, min(-(-n // bucket_rows), MAX_BUCKETS))
    batch = max(1, min(batch, TASK_WEIGHTS // max(1, -(-n // buckets))))
    rows = wide.select(F.col(id_column).cast("string").alias("_id"), "y", *models).withColumn(
        "_bucket", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(buckets)).cast("int"))
    found = {r["_bucket"]: r["n"] for r in rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    sizes = [found.get(b, 0) for b in range(buckets)]
    in_range = _range_column(rows, models, min(buckets, MAX_RANGES))

    parts = []
    for start in range(0, replicates, batch):
        reps = range(start, min(start + batch, replicates))
        draws = _bucket_draws(spark, sizes, reps, seed)
        scored = _weighted_scores(rows, draws, models, seed).withColumn("_range", in_range)
        parts.append(_batch_metrics(scored, thresholds, reps))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _batch_metrics(scored: DataFrame, thresholds: dict[str, float], reps: range) -> DataFrame:
    ids = np.arange(reps.start, reps.stop, dtype=np.int32)

    def totals(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        pos, neg = _rows_to_matrix(mine["pos"]), _rows_to_matrix(mine["neg"])
        flagged = mine["score"].to_numpy() >= thresholds[key[0]]
        return pd.DataFrame({"model": key[0], "_range": key[1], "rep": ids, "pos": pos.sum(axis=0), "neg": neg.sum(axis=0),
                             "tp": pos[flagged].sum(axis=0), "fp": neg[flagged].sum(axis=0)})

    cells = scored.groupBy("model", "_range").applyInPandas(
        totals, "model string, _range int, rep int, pos long, neg long, tp long, fp long")
    # Ranges of one replicate: a bounded number of rows.
    whole = W.partitionBy("model", "rep")
    above = whole.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select(
        "model", "_range", "rep", "tp", "fp",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("neg_before"),
        F.sum("pos").over(whole).alias("pos_all"), F.sum("neg").over(whole).alias("neg_all"))

    def inside(key: tuple, mine: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        start = start.sort_values("rep")
        _, pos, neg = _merge_equal(mine["score"].to_numpy(dtype=float), _rows_to_matrix(mine["pos"]),
                                   _rows_to_matrix(mine["neg"]))
        pos, neg = pos.astype(float), neg.astype(float)
        tp = start["pos_before"].to_numpy() + np.cumsum(pos, axis=0)
        fp = start["neg_before"].to_numpy() + np.cumsum(neg, axis=0)
        wins = (pos * (start["neg_all"].to_numpy() - fp + neg / 2)).sum(axis=0)
        steps = np.where(pos > 0, pos * tp / np.maximum(tp + fp, 1), 0.0).sum(axis=0)
        return pd.DataFrame({"model": key[0], "rep": start["rep"], "wins": wins, "steps": steps, "tp": start["tp"],
                             "fp": start["fp"], "pos": start["pos_all"], "neg": start["neg_all"]})

    local = scored.groupBy("model", "_range").cogroup(starts.groupBy("model", "_range")).applyInPandas(
        inside, "model string, rep int, wins double, steps double, tp long, fp long, pos long, neg long")
    tp, fp = F.sum("tp"), F.sum("fp")
    pos = F.max("pos").cast("double")
    return local.groupBy("rep", "model").agg(
        ratio(F.sum("wins"), pos * F.max("neg")).alias("roc_auc"),
        ratio(F.sum("steps"), pos).alias("average_precision"),
        ratio_or_zero(2.0 * tp, tp + fp + pos).alias("f1"))


METRICS = ["roc_auc", "average_precision", "f1"]


def paired_bootstrap(wide: DataFrame, pairs: list[tuple[str, str]], thresholds: dict[str, float],
                     replicates: int = 2000, seed: int = 42, alpha: float = 0.05, **kw) -> DataFrame:
    """Differences of AUC, average precision and F1 of model pairs on the same resampled rows.

    One row per (pair, metric): observed difference, replicate mean, percentile interval and
    p = min(1, 2 min(P(d <= 0), P(d >= 0)) + 1 / (replicates + 1)). Differences are rounded to 12 digits, so
    equal metrics differ by nothing.
    """
    models = list(thresholds)
    table = materialize(replicate_metrics(wide, thresholds, replicates, seed, **kw))
    per_rep = table.groupBy("rep").pivot("model", models).agg(*[F.first(m).alias(m) for m in METRICS])

    def cell(model: str, metric: str):
        return F.col(f"`{model}_{metric}`")

    deltas = per_rep.select("rep", F.inline(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(m).alias("metric"),
                 F.round(cell(a, m) - cell(b, m), 12).alias("d")) for a, b in pairs for m in METRICS])))
    share = F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    # One row per replicate and pair: a count fixed by the call.
    summary = deltas.filter(F.col("d").isNotNull()).groupBy("model_a", "model_b", "metric").agg(
        F.avg("d").alias("mean"),
        F.percentile("d", F.lit(alpha / 2)).alias("lo"), F.percentile("d", F.lit(1 - alpha / 2)).alias("hi"),
        F.least(F.lit(1.0), 2 * share + F.lit(1.0 / (replicates + 1))).alias("p_value"))
    observed = _observed_deltas(wide, pairs, thresholds)
    return summary.join(observed, ["model_a", "model_b", "metric"]).withColumn(
        "excludes_zero", ~((F.col("lo") <= 0) & (F.col("hi") >= 0)))


def _observed_deltas(wide: DataFrame, pairs: list[tuple[str, str]], thresholds: dict[str, float]) -> DataFrame:
    models = list(thresholds)
    long = wide.unpivot(["y"], models, "model", "score")
    cut = F.element_at(F.create_map(*[F.lit(x) for m, t in thresholds.items() for x in (m, float(t))]), F.col("model"))
    values = ranking_metrics(long, ["model"]).join(threshold_metrics(long, cut, ["model"]), "model").select("model", *METRICS)
    row = values.groupBy().pivot("model", models).agg(*[F.first(m).alias(m) for m in METRICS])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(m).alias("metric"),
                 (F.col(f"`{a}_{m}`") - F.col(f"`{b}_{m}`")).alias("observed")) for a, b in pairs for m in METRICS])))


def bootstrap_auc_interval(wide: DataFrame, models: list[str], replicates: int = 200, alpha: float = 0.05,
                           seed: int = 42, **kw) -> DataFrame:
    """Percentile interval of each model's AUC."""
    table = replicate_metrics(wide, {m: 0.5 for m in models}, replicates, seed, **kw)
    return table.filter(F.col("roc_auc").isNotNull()).groupBy("model").agg(
        F.percentile("roc_auc", F.lit(alpha / 2)).alias("lo"), F.percentile("roc_auc", F.lit(1 - alpha / 2)).alias("hi"),
        F.count("*").alias("replicates"))


def three_test_table(delong: DataFrame, mcnemar: DataFrame, bootstrap: DataFrame, alpha: float = 0.05) -> DataFrame:
    """DeLong, McNemar and bootstrap side by side, Holm-adjusted within the family per test.

    `delong` carries `family`; all three are keyed by (model_a, model_b).
    """
    from rankfold.functions.scalars import interval_label
    from rankfold.operators.compare import MARGIN, holm

    keys = ["model_a", "model_b"]
    wide_boot = bootstrap.groupBy(*keys).pivot("metric", METRICS).agg(
        *[F.first(c).alias(c) for c in ("mean", "lo", "hi", "p_value", "excludes_zero")])
    table = (delong.select(*keys, "family", "delta", F.col("p_value").alias("p_delong"))
             .join(mcnemar.select(*keys, "b", "c", F.col("p_value").alias("p_mcnemar")), keys).join(wide_boot, keys))
    for p in ["p_delong", "p_mcnemar", *[f"{m}_p_value" for m in METRICS]]:
        table = holm(table, p, ["family"], f"{p}_holm")
    return table.select(
        "family", *keys, "delta", F.col("p_delong_holm"), (F.col("p_delong_holm") < alpha).alias("delong_sig"),
        F.concat_ws(" / ", F.col("b").cast("string"), F.col("c").cast("string")).alias("b_c"),
        "p_mcnemar_holm", (F.col("p_mcnemar_holm") < alpha).alias("mcnemar_sig"),
        *[interval_label(f"{m}_mean", f"{m}_lo", f"{m}_hi").alias(f"{m}_interval") for m in METRICS],
        *[F.col(f"{m}_excludes_zero").alias(f"{m}_sig") for m in METRICS],
        *[f"{m}_p_value_holm" for m in METRICS],
        (F.abs("delta") >= MARGIN).alias("relevant"))
