from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import compare as C, ordering
from rankfold.operators.association import corrected_v


def brute_delong(y, s1, s2):
    pos, neg = np.array([s1, s2])[:, y == 1], np.array([s1, s2])[:, y == 0]
    d = pos[:, :, None] - neg[:, None, :]
    psi = (d > 0) + 0.5 * (d == 0)
    v10, v01 = psi.mean(axis=2), psi.mean(axis=1)
    cov = np.cov(v10) / pos.shape[1] + np.cov(v01) / neg.shape[1]
    delta = v10.mean(axis=1)[0] - v10.mean(axis=1)[1]
    return delta, delta / np.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])


def test_counts_ranks_and_all_pairs_agree(scores):
    df, frame = scores
    fast = {(r["model_a"], r["model_b"]): r for r in C.delong(df, ["a", "b", "c"]).collect()}
    direct = {(r["model_a"], r["model_b"]): r for r in C.delong_by_ranks(df, ["a", "b", "c"]).collect()}
    y = frame["y"].to_numpy()
    for (m1, m2), row in fast.items():
        delta, z = brute_delong(y, frame[m1].to_numpy(), frame[m2].to_numpy())
        assert (row["delta"], row["z"]) == pytest.approx((delta, z), abs=1e-8)
        assert (direct[m1, m2]["z"], direct[m1, m2]["p_value"]) == pytest.approx((row["z"], row["p_value"]), abs=1e-6)


def test_plan_of_components_grows_with_the_models_not_faster(scores, monkeypatch):
    """With the broadcast of value tables switched off, as for scores with many distinct values."""
    monkeypatch.setattr(C, "lookup", partial(ordering.lookup, broadcast_rows=0))
    df, _ = scores
    wide = df.select("id", "y", "a", "b", "c", *[(F.col("b") * k).alias(f"b{k}") for k in (2, 3, 4)])

    def size(models):
        plan = C.components(wide, models)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join "), plan.count("InMemoryRelation")

    sizes = [size(["a", "b", "c", "b2", "b3", "b4"][:m]) for m in (1, 2, 4, 6)]
    assert all(big[0] <= m * sizes[0][0] and big[1] <= m * sizes[0][1] for m, big in zip((2, 4, 6), sizes[1:]))


def test_components_are_the_same_without_broadcast(scores, monkeypatch):
    df, _ = scores
    want = C.delong(df, ["a", "b", "c"]).collect()
    monkeypatch.setattr(C, "lookup", partial(ordering.lookup, broadcast_rows=0))
    for x, y in zip(want, C.delong(df, ["a", "b", "c"]).collect()):
        assert x["z"] == pytest.approx(y["z"], abs=1e-9) and x["auc1"] == pytest.approx(y["auc1"], abs=1e-12)


def test_identical_scores_and_antisymmetry(scores):
    df, _ = scores
    same = C.delong(df.withColumn("a2", F.col("a")), ["a", "a2"]).first()
    assert (same["delta"], same["z"], same["p_value"]) == (0.0, 0.0, 1.0)
    pairs = {(r["model_a"], r["model_b"]): r["delta"] for r in C.delong(df, ["a", "b"], [("a", "b"), ("b", "a")]).collect()}
    assert pairs["a", "b"] == -pairs["b", "a"]
    matrix = {r["model"]: r for r in C.pair_matrix(C.delong(df, ["a", "b", "c"]), ["a", "b", "c"], "delta", -1).collect()}
    assert matrix["a"]["a"] is None and matrix["a"]["c"] == -matrix["c"]["a"]


def test_layout_does_not_matter(scores):
    df, _ = scores
    z = [C.delong(df.repartition(k), ["a", "b"]).first()["z"] for k in (1, 13)]
    assert z[0] == pytest.approx(z[1], abs=1e-9)


def test_wide_and_long_forms(scores):
    df, frame = scores
    back = C.to_wide(C.to_long(df, ["a", "b"]), ["a", "b"])
    assert back.count() == len(frame) and back.exceptAll(df.select("id", "y", "a", "b")).count() == 0


# adjusted p of six comparisons, from their z
Z = [0.7003308917802709, 3.284423413354177, 5.728730134157669, 3.1028593953716483, -57.73050769221841, 12.402582205349912]
HOLM = [0.4837206838601925, 0.003065738045797739, 4.047408568940434e-08, 0.003833213507924316, 0.0, 1.2651792724454534e-34]


def test_holm_from_stored_values(spark):
    from rankfold.functions.tails import normal_p

    table = spark.createDataFrame([(i, z) for i, z in enumerate(Z)], "i int, z double").withColumn("p", normal_p("z")).withColumn("family", F.lit("f"))
    got = [r["p_holm"] for r in C.holm(table, "p", ["family"]).orderBy("i").collect()]
    assert got == pytest.approx(HOLM, rel=1e-9, abs=1e-300)


def test_holm_keeps_families_and_nulls_apart(spark):
    rows = [("x", 0.01), ("x", 0.04), ("x", 0.03), ("y", 0.5), ("y", None)]
    got = C.holm(spark.createDataFrame(rows, "family string, p double"), "p", ["family"]).collect()
    assert {(r["family"], r["p"]): r["p_holm"] for r in got} == pytest.approx(
        {("x", 0.01): 0.03, ("x", 0.03): 0.06, ("x", 0.04): 0.06, ("y", 0.5): 0.5, ("y", None): None})


MCNEMAR = [(318, 1237, 7.118192210764833e-120), (15722, 15386, 0.05751631180571488), (6176, 5475, 8.867504556020406e-11),
           (8220, 5379, 5.297718552413064e-131), (32540, 167409, 0.0), (318, 1192, 8.927785435497481e-112),
           (9564, 6360, 3.956236532692597e-142), (10189, 9125, 2.0275665839882135e-14)]


def test_mcnemar_from_stored_counts(spark):
    got = {(r["b"], r["c"]): r["p_value"] for r in C.mcnemar_table(spark.createDataFrame([m[:2] for m in MCNEMAR], "b long, c long")).collect()}
    for b, c, p in MCNEMAR:
        assert got[b, c] == pytest.approx(p, rel=1e-9, abs=1e-300)


def test_mcnemar_branches(spark):
    table = C.mcnemar_table(spark.createDataFrame([(0, 0), (4, 20), (5, 20), (12, 12)], "b long, c long"))
    got = {(r["b"], r["c"]): (r["method"], r["p_value"]) for r in table.collect()}
    assert got[0, 0] == ("none", 1.0) and got[12, 12] == ("exact", 1.0)
    assert got[4, 20][0] == "exact" and got[4, 20][1] == pytest.approx(2 * sum([1, 24, 276, 2024, 10626]) / 2**24)
    assert got[5, 20][0] == "chi2"


V = [(33436.97356541286, 2, 0.17625888141764437), (9203.081442985327, 3, 0.0924620377326178), (5402.5517138040905, 6, 0.07081779965261442),
     (3322.644816184943, 14, 0.055454234761304774), (2731.942672486035, 51, 0.049919331924057404)]


def test_cramers_v_from_stored_statistics(spark):
    table = spark.createDataFrame([(x, r) for x, r, _ in V], "x double, r int")
    got = {r["r"]: r["v"] for r in table.select("r", corrected_v(F.col("x"), F.lit(1076248), F.col("r"), F.lit(2)).alias("v")).collect()}
    for _, r, v in V:
        assert got[r] == pytest.approx(v, abs=1e-14)


def test_score_check_reports_every_fault(spark):
    base = spark.createDataFrame([("1", 1), ("2", 0), ("3", 0)], "id string, y int")
    good = spark.createDataFrame([("3", 0, 0.3), ("1", 1, 0.1), ("2", 0, 0.2)], "id string, y int, score double")
    assert C.score_join_check(base, good).first()["identical"]
    bad = spark.createDataFrame([("1", 0, 0.1), ("2", 0, 0.2), ("9", 0, 0.2)], "id string, y int, score double")
    row = C.score_join_check(base, bad).first()
    assert (row["missing_score"], row["label_differs"], row["surplus"], row["identical"]) == (1, 1, 1, False)
