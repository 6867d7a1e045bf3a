import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import metrics as M
from rankfold.operators import report as R


def brute_auc(y, s):
    """Share of pairs of a positive and a negative row in which the positive scores higher; ties count half."""
    won = 0.0
    positive, negative = [v for v, k in zip(s, y) if k == 1], np.sort([v for v, k in zip(s, y) if k == 0])
    for v in positive:
        lower, not_higher = np.searchsorted(negative, v, "left"), np.searchsorted(negative, v, "right")
        won += (lower + not_higher) / 2
    return won / (len(positive) * len(negative))


def brute_ap(y, s):
    total, seen = 0.0, 0
    for v in sorted(set(s), reverse=True):
        at = s >= v
        tp = y[at].sum()
        total += (tp - seen) / y.sum() * tp / at.sum()
        seen = tp
    return total


@pytest.mark.parametrize("limit", [0, 10**6])
def test_ranking_metrics_against_brute_force(scores, limit):
    df, frame = scores
    long = df.unpivot(["id", "y"], ["a", "b", "c"], "model", "score")
    found = M.score_distribution(long, ["model"], plain_limit=limit, range_rows=200)
    got = {r["model"]: r for r in M.ranking_metrics(long, ["model"], found=found).collect()}
    y = frame["y"].to_numpy()
    for m in ("a", "b", "c"):
        s = frame[m].to_numpy()
        assert got[m]["roc_auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
        assert got[m]["average_precision"] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_auc_of_reversed_and_constant_scores(scores):
    df, _ = scores
    a = M.auc(df, [], "a").first()["roc_auc"]
    assert M.auc(df.withColumn("a", 1 - F.col("a")), [], "a").first()["roc_auc"] == pytest.approx(1 - a, abs=1e-12)
    constant = df.withColumn("a", F.lit(0.7))
    assert M.auc(constant, [], "a").first()["roc_auc"] == 0.5
    assert M.best_f1_threshold(constant, [], "a").first()["threshold"] == 0.02


# tn, fp, fn, tp -> accuracy, balanced accuracy, precision, recall, specificity, f1, mcc
STORED = [
    ((211383, 3967, 49407, 4305), (0.8016293642357524, 0.5308642561945317, 0.5204303675048356, 0.08014968722073279, 0.9815788251683306, 0.1389068146618482, 0.1429365122721464)),
    ((146944, 68406, 20412, 33300), (0.6698976444090953, 0.6511614268436382, 0.32741431184000946, 0.6199731903485255, 0.6823496633387509, 0.4285217928425279, 0.24922129456511719)),
    ((215350, 0, 53712, 0), (0.8003731481963265, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0)),
    ((191487, 23863, 37609, 16103), (0.7715322119065494, 0.5944961711885086, 0.4029174798578792, 0.29980265117664584, 0.8891896912003715, 0.3437947009970324, 0.21242137341016848)),
]


def test_threshold_metrics_from_stored_counts(spark):
    counts = spark.createDataFrame([c for c, _ in STORED], "tn long, fp long, fn long, tp long")
    names = ["accuracy", "balanced_acc", "precision", "recall", "specificity", "f1", "mcc"]
    got = {r["tn"]: [r[n] for n in names] for r in M.with_threshold_metrics(counts).collect()}
    for (tn, *_), want in STORED:
        assert got[tn] == pytest.approx(want, abs=1e-15)


def test_huge_counts_do_not_overflow(spark):
    n = 10**13
    counts = spark.createDataFrame([(n, n, n, n)], "tn long, fp long, fn long, tp long")
    assert M.with_threshold_metrics(counts).first()["mcc"] == 0.0


def test_only_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")
    row = M.threshold_metrics(df, 0.5).first()
    assert (row["tp"], row["fn"], row["specificity"], row["recall"]) == (1, 1, None, 0.5)
    assert M.auc(df, []).first()["roc_auc"] is None


def brute_best(y, s, grid):
    best = (-1.0, None)
    for t in grid:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        f1 = 2 * tp / max(2 * tp + fp + (y.sum() - tp), 1)
        if f1 > best[0]:
            best = (f1, t)
    return best


def test_best_threshold_on_probabilities_and_margins(scores):
    df, frame = scores
    y = frame["y"].to_numpy()
    long = df.unpivot(["id", "y"], ["a", "b"], "model", "score")
    got = {r["model"]: r for r in M.best_f1_threshold(long, ["model"]).collect()}
    f1, t = brute_best(y, frame["a"].to_numpy(), np.linspace(0.02, 0.98, 199))
    assert (got["a"]["f1"], got["a"]["threshold"]) == pytest.approx((f1, t), abs=1e-12)
    b = frame["b"].to_numpy()
    f1, t = brute_best(y, b, np.unique(np.quantile(b, np.linspace(0.02, 0.98, 199))))
    assert (got["b"]["f1"], got["b"]["threshold"]) == pytest.approx((f1, t), abs=1e-9)
    alone = M.best_f1_threshold(df, [], "b").first()
    assert alone["f1"] == pytest.approx(f1, abs=1e-9)


def test_curves_end_where_they_should(scores):
    df, _ = scores
    roc = M.roc_points(df, [], "a").toPandas()
    assert (roc["fpr"].max(), roc["tpr"].max(), roc["fpr"].min(), roc["tpr"].min()) == (1, 1, 0, 0)
    order = roc.sort_values(["fpr", "tpr"])
    area = np.trapezoid(order["tpr"], order["fpr"])
    assert area == pytest.approx(M.auc(df, [], "a").first()["roc_auc"], abs=1e-12)
    pr = M.pr_points(df, [], "a").toPandas()
    assert ((pr["recall"] == 0) & (pr["precision"] == 1)).any() and pr["recall"].max() == 1


def test_degenerate_score_is_marked(spark):
    df = spark.createDataFrame([("flat", -1.0), ("flat", -1.0 + 1e-13), ("wide", 0.1), ("wide", 0.9)], "model string, score double")
    assert {r["model"]: r["degenerate"] for r in M.score_dispersion(df, ["model"]).collect()} == {"flat": True, "wide": False}


# rows -> seconds of three versions of one job, and their published fixed / per-million costs
CURVES = {
    "one": ([0.2575974464416504, 0.6570122241973877, 1.2061026096343994, 3.2981343269348145, 6.891181945800781, 16.190970420837402], (-0.2, 15.0)),
    "two": ([160.99033069610596, 172.15296602249146, 179.18680953979492, 201.45995831489563, 219.23130464553833, 257.5911293029785], (169.9, 86.2)),
    "three": ([11.923309803009033, 13.303683042526245, 16.36090064048767, 27.26462411880493, 40.374563455581665, 69.41921877861023], (11.7, 54.5)),
}
VOLUMES = [10_000, 50_000, 100_000, 250_000, 500_000, 1_076_248]


def test_affine_fit_and_dominance(spark):
    rows = [(name, n, t) for name, (times, _) in CURVES.items() for n, t in zip(VOLUMES, times)]
    table = spark.createDataFrame(rows, "version string, n_rows long, seconds double")
    for r in R.affine_fit(table, ["version"], "n_rows", "seconds").collect():
        want = CURVES[r["version"]][1]
        assert (round(r["fixed"], 1), round(r["slope"] * 1e6, 1)) == want
    joined = R.join_curves({v: table.filter(F.col("version") == v) for v in CURVES}, "n_rows", "seconds")
    got = {r["curve"]: (r["ever_below"], r["points_below"]) for r in R.dominance(joined, "one", ["two", "three"]).collect()}
    assert got == {"two": (False, 0), "three": (False, 0)}
