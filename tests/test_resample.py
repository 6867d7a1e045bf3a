import numpy as np
import pandas as pd
import pytest

from rankfold.operators import resample as B
from rankfold.operators.counterboot import counter_replicates, draw_weights, weight_limits
from rankfold.operators.metrics import auc


def weighted_auc(y, s, w):
    """Area under the ROC curve by trapezoids over the weighted shares at each distinct score."""
    x = height = area = 0.0
    for v in sorted(set(s), reverse=True):
        more_x, more = w[(s == v) & (y == 0)].sum() / w[y == 0].sum(), w[(s == v) & (y == 1)].sum() / w[y == 1].sum()
        area += more_x * (height + more / 2)
        x, height = x + more_x, height + more
    return area


def weighted_ap(y, s, w):
    total, seen = 0.0, 0
    for v in sorted(set(s), reverse=True):
        at = s >= v
        tp = w[at & (y == 1)].sum()
        if w[at].sum():
            total += (tp - seen) / w[y == 1].sum() * tp / w[at].sum()
        seen = tp
    return total


def test_metrics_of_given_weights(spark):
    """Range starts and sums inside ranges together give the weighted metrics."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    n, reps = 400, 7
    y, s = rng.integers(0, 2, n), np.round(rng.random(n), 2)
    w = rng.poisson(1.0, (n, reps)).astype(np.int32)
    zero = np.zeros(reps, dtype=np.int32).tobytes()
    rows = [("m", float(s[i]), w[i].tobytes() if y[i] else zero, zero if y[i] else w[i].tobytes()) for i in range(n)]
    packed = spark.createDataFrame(rows, "model string, score double, pos binary, neg binary")
    for ranges in (1, 9):
        scored = packed.withColumn("_range", F.floor(F.col("score") * ranges).cast("int"))
        got = {r["rep"]: r for r in B._batch_metrics(scored, {"m": 0.5}, range(3, 3 + reps)).collect()}
        for j in range(reps):
            row = got[3 + j]
            assert row["roc_auc"] == pytest.approx(weighted_auc(y, s, w[:, j]), abs=1e-12)
            assert row["average_precision"] == pytest.approx(weighted_ap(y, s, w[:, j]), abs=1e-12)
            flagged = s >= 0.5
            tp = w[flagged & (y == 1), j].sum()
            assert row["f1"] == pytest.approx(2 * tp / (w[flagged, j].sum() + w[y == 1, j].sum()), abs=1e-12)


def test_every_replicate_draws_n_rows(spark):
    draws = B._bucket_draws(spark, [10, 0, 25, 65], range(5, 25), 42).toPandas()
    assert (draws.groupby("rep")["k"].sum() == 100).all() and draws["rep"].nunique() == 20
    assert (draws[draws["_bucket"] == 1]["k"] == 0).all()


@pytest.mark.parametrize("weights", ["multinomial", "counter"])
def test_bootstrap_spread_matches_plain_resampling(scores, weights):
    df, frame = scores
    table = B.replicate_metrics(df, {"a": 0.5, "b": 0.0}, 120, bucket_rows=400, batch=50, weights=weights).toPandas()
    assert len(table) == 240 and table["rep"].nunique() == 120
    y, s = frame["y"].to_numpy(), frame["b"].to_numpy()
    rng = np.random.default_rng(1)

    def rank_auc(yy, ss):
        r = pd.Series(ss).rank().to_numpy()
        m = yy.sum()
        return (r[yy == 1].sum() - m * (m + 1) / 2) / (m * (len(yy) - m))

    plain = np.array([rank_auc(y[i], s[i]) for i in (rng.integers(0, len(y), len(y)) for _ in range(400))])
    mine = table[table["model"] == "b"]["roc_auc"]
    assert mine.mean() == pytest.approx(plain.mean(), abs=4 * plain.std() / np.sqrt(120))
    assert mine.std() == pytest.approx(plain.std(), rel=0.3)


def test_reruns_and_layouts_give_the_same_replicates(scores):
    df, _ = scores
    one = B.replicate_metrics(df, {"a": 0.5}, 10, bucket_rows=300).toPandas().sort_values("rep")
    two = B.replicate_metrics(df.repartition(11), {"a": 0.5}, 10, bucket_rows=300, batch=3).toPandas().sort_values("rep")
    assert list(one["roc_auc"]) == pytest.approx(list(two["roc_auc"]), abs=1e-12)


def test_paired_summary(scores):
    df, _ = scores
    rows = {r["metric"]: r for r in B.paired_bootstrap(df, [("a", "c")], {"a": 0.5, "c": 0.5}, 60).collect()}
    assert set(rows) == set(B.METRICS)
    observed = auc(df, [], "a").first()["roc_auc"] - auc(df, [], "c").first()["roc_auc"]
    row = rows["roc_auc"]
    assert row["observed"] == pytest.approx(observed, abs=1e-12)
    assert row["lo"] < observed < row["hi"] and row["excludes_zero"] and row["p_value"] == pytest.approx(1 / 61)


@pytest.mark.parametrize("part_rows", [70, 10**6])
def test_counter_replicates_equal_weighted_metrics(scores, part_rows):
    """A third of all rows share a score of `a`, which fills whole parts."""
    df, frame = scores
    cut = {"a": 0.45, "b": 0.2, "c": 0.5}
    got = {(r["rep"], r["model"]): r for r in counter_replicates(df, cut, 21, seed=7, part_rows=part_rows).collect()}
    assert len(got) == 63
    weights = draw_weights([i.encode() for i in frame["id"]], range(21), 7)
    y = frame["y"].to_numpy()
    for rep in (0, 7, 8, 20):
        w = weights[:, rep]
        for m in cut:
            s, row = frame[m].to_numpy(), got[rep, m]
            assert row["roc_auc"] == pytest.approx(weighted_auc(y, s, w), abs=1e-12)
            assert row["average_precision"] == pytest.approx(weighted_ap(y, s, w), abs=1e-12)
            flagged = s >= cut[m]
            assert row["f1"] == pytest.approx(2 * w[flagged & (y == 1)].sum() / (w[flagged].sum() + w[y == 1].sum()), abs=1e-12)


def test_counter_weights_follow_the_poisson_law():
    ids = [str(i).encode() for i in range(4000)]
    whole = draw_weights(ids, range(0, 40), 3)
    assert (draw_weights(ids[:50], range(13, 21), 3) == whole[:50, 13:21]).all()
    assert whole.mean() == pytest.approx(1, abs=0.01) and whole.var() == pytest.approx(1, abs=0.02)
    assert np.corrcoef(whole[:, :8].T)[np.triu_indices(8, 1)].max() < 0.08
    assert weight_limits()[:3] == [24109, 48219, 60273]


def test_bootstrap_covers_all_pairs_in_full():
    from rankfold.plans import comparison as P

    assert (len(P.PAIRS), P.REPLICATES, P.INTERVAL_REPLICATES, set(P.FAMILIES.values())) == (6, 2000, 200, {"A", "B"})


def test_digests_worked_out_together_are_md5():
    """Ids of all lengths, also those that fill an md5 block or go beyond it, and blocks of one to three digits."""
    from hashlib import md5

    ids = [b"", b"7", "é".encode(), *[b"x" * n for n in (46, 47, 48, 49, 50, 55, 56, 64, 130)]]
    limits = weight_limits()
    got = draw_weights(ids, range(60, 820), 42)
    for row, i in zip(got, ids):
        for rep in (60, 79, 80, 500, 799, 800, 819):
            digest = md5(f"42:{rep // 8}:".encode() + i).digest()
            number = int.from_bytes(digest[2 * (rep % 8):2 * (rep % 8) + 2], "big")
            assert row[rep - 60] == sum(number >= limit for limit in limits)


def test_few_scores_are_drawn_once_and_give_the_same_replicates(spark, scores, monkeypatch):
    """Models of few scores are summed by score, others by order; nulls of a score, a label or an id take no part."""
    from rankfold.operators import counterboot
    from pyspark.sql import functions as F

    df, _ = scores
    df = df.withColumn("a", F.expr("CASE WHEN id LIKE '%7' THEN NULL ELSE a END")).withColumn("y", F.expr("CASE WHEN id = 'r3' THEN NULL ELSE y END"))
    cut = {"a": 0.45, "b": 0.2, "c": 0.5}
    assert set(counterboot._few_scores(df, list(cut), 500)) == {"a", "c"}
    monkeypatch.setattr(counterboot, "TASK_ROWS", 700)
    monkeypatch.setattr(counterboot, "CHUNK_ROWS", 300)
    monkeypatch.setattr(counterboot, "FULL_ROWS", 500)
    key = lambda r: (r["rep"], r["model"])
    summed, ordered = (sorted(counter_replicates(df, cut, 21, seed=7, max_cells=most).collect(), key=key) for most in (500, 0))
    assert [key(r) for r in summed] == [key(r) for r in ordered] and len(summed) == 63
    for m in ("roc_auc", "average_precision", "f1"):
        assert [r[m] for r in summed] == pytest.approx([r[m] for r in ordered], abs=1e-12)
