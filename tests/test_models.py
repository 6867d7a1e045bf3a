import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rankfold.operators import explain as E
from rankfold.operators import models as L
from rankfold.operators import restate as T
from rankfold.operators import features as X
from rankfold.operators.split import make_split


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 900
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    kind = rng.choice(["p", "q"], n)
    y = (x1 * 1.5 + (kind == "q") + rng.normal(size=n) > 0.5).astype(int)
    frame = pd.DataFrame({"id": [str(i) for i in range(n)], "default": y, "x1": x1, "x2": x2, "kind": kind})
    df = spark.createDataFrame(frame).cache()
    train, test, fitted, kept = X.prepare(df, make_split(df), ["x1", "x2"], ["kind"])
    return df, train.cache(), test.cache(), fitted


def test_six_specifications(spark):
    specs = L.model_specs()
    assert [len(specs[k].grid) for k in L.MODEL_KEYS] == [3, 3, 9, 4, 3, 1]
    assert specs["SVM"].default_threshold == 0.0 and specs["LR"].default_threshold == 0.5


def by_refit(estimator, train, score_column):
    """Out-of-fold scores with a model fitted anew for each fold."""
    out = {}
    for k in range(3):
        model = estimator.fit(train.filter(F.col("fold") != k))
        out |= {r["id"]: r["score"] for r in L.score(model, train.filter(F.col("fold") == k), score_column).collect()}
    return out


@pytest.mark.parametrize("key, grid", [("LR", {"reg_params": [1e-1, 1e-4]}), ("SVM", {"reg_params": [1e-4]}), ("DT", {"depths": [2, 4]})])
def test_out_of_fold_scores_are_those_of_a_refit(data, key, grid):
    _, train, _, _ = data
    spec = L.model_specs(max_iter=10, **grid)[key]
    found = L.cross_validate(spec, train)
    scores = L.oof_scores(found.fold_models, train, spec.score_column)
    rows = {r["id"]: r["score"] for r in scores.collect()}
    want = by_refit(L.with_params(spec.estimator, L.best_params(spec, found)), train, spec.score_column)
    assert len(rows) == scores.count() == train.count() and rows.keys() == want.keys()
    assert [rows[i] for i in rows] == pytest.approx([want[i] for i in rows], abs=1e-9)
    row = L.oof_threshold(scores, spec.score_column).first()
    assert row["f1"] > 0.6 and (key == "SVM" or 0.02 <= row["threshold"] <= 0.98)


def test_search_equals_spark_cross_validation(data):
    from pyspark.ml.tuning import CrossValidator

    _, train, _, _ = data
    spec = L.model_specs(max_iter=10, reg_params=[1.0, 1e-1, 1e-4])["LR"]
    found = L.cross_validate(spec, train, parallelism=3)
    theirs = CrossValidator(estimator=spec.estimator, estimatorParamMaps=spec.grid, evaluator=L.evaluator(spec.score_column), numFolds=3,
                            foldCol="fold").fit(train)
    assert found.means == pytest.approx(theirs.avgMetrics, abs=1e-9) and found.deviations == pytest.approx(theirs.stdMetrics, abs=1e-9)
    assert found.best == int(np.argmax(theirs.avgMetrics)) and len(found.fold_models) == 3
    assert list(found.model.coefficients) == pytest.approx(list(theirs.bestModel.coefficients), abs=1e-9)


class Unfit:
    """Stands where an estimator must not be asked to fit."""

    def __getattr__(self, name):
        raise AssertionError("a finished search was fitted again")


def test_second_session_reads_the_store(spark, data, tmp_path, monkeypatch):
    from rankfold.operators import search

    _, train, _, _ = data
    spec = L.model_specs(depths=[2, 3])["DT"]
    store = search.ModelStore(spark, str(tmp_path))
    first = L.cross_validate(spec, train, store=store)
    monkeypatch.setattr(search, "fold_search", lambda *_, **__: Unfit().fit())
    again = L.cross_validate(spec, train.repartition(3), store=search.ModelStore(spark.newSession(), str(tmp_path)))
    assert (again.means, again.best) == (first.means, first.best) and len(again.fold_models) == 3
    held = [{r["id"]: r["score"] for r in L.oof_scores(f.fold_models, train, spec.score_column).collect()} for f in (first, again)]
    assert held[0] == held[1]
    for changed, other in ((train.withColumn("default", 1 - F.col("default")), spec), (train.filter("fold < 2"), spec), (train, L.model_specs(depths=[2, 5])["DT"])):
        with pytest.raises(AssertionError, match="fitted again"):
            L.cross_validate(other, changed, store=store)


def test_unfinished_searches_are_not_read(spark, data, tmp_path):
    from rankfold.operators import search

    _, train, _, _ = data
    spec = L.model_specs(depths=[2])["DT"]
    store = search.ModelStore(spark, str(tmp_path))
    place = store.place(search.rows_fingerprint(train), search.described(spec.estimator, spec.grid), "areaUnderROC", "3")
    (tmp_path / place.split("/")[-1] / "record").mkdir(parents=True)
    assert L.cross_validate(spec, train, store=store).model.getMaxDepth() == 2


def test_search_record_and_resume(data, tmp_path):
    _, train, test, _ = data
    spec = L.model_specs(depths=[2, 4])["DT"]
    record = L.run_model("DT", spec, train, test, str(tmp_path)).first()
    assert record["auc_test"] > 0.7 and record["best_params"]["maxDepth"] in (2.0, 4.0)
    again = L.run_model("DT", spec, train.limit(0), test.limit(0), str(tmp_path)).first()
    assert again == record
    model = L.refit(spec, record["best_params"], train)
    assert model.getMaxDepth() == int(record["best_params"]["maxDepth"])


def test_importances_find_the_signal(data):
    df, train, _, fitted = data
    spec = L.model_specs()["RF"]
    model = L.refit(spec, {"numTrees": 10, "maxDepth": 4}, train)
    impurity = {r["feature"]: r["importance"] for r in L.impurity_importance(model, train).collect()}
    assert impurity["x1"] > impurity["x2"]
    from pyspark.ml import PipelineModel

    chain = PipelineModel(stages=[fitted, model])
    drop = {r["column"]: r["importance"] for r in E.permutation_importance(chain, df, ["x1", "x2", "kind"], "default", sample=None).collect()}
    assert drop["x1"] > drop["kind"] > drop["x2"] and abs(drop["x2"]) < 0.05


def test_surrogate_recovers_a_linear_score(spark, data):
    df, train, _, fitted = data
    from pyspark.ml import PipelineModel

    model = PipelineModel(stages=[fitted, L.refit(L.model_specs(max_iter=30)["LR"], {"regParam": 1e-4}, train)])
    reference = E.Reference(df, ["x1", "x2"], ["kind"])
    out = E.local_surrogate(model, df.limit(3), reference, samples=1500, top=3, seeds=[1, 2]).toPandas().sort_values(["id", "seed", "position"])
    assert len(out) == 3 * 2 * 3
    assert (out.groupby(["id", "seed"])["weight"].apply(lambda w: w.abs().is_monotonic_decreasing)).all()
    assert out[out["position"] == 1]["feature"].isin(["x1", "kind"]).all() and (out["r2"] > 0.05).all() and out["r2"].max() > 0.4
    assert out[out["feature"] == "kind"]["condition"].str.match("kind=[pq]").all()


def test_perturbation_keeps_the_instance_and_the_level_shares(spark, data):
    df, *_ = data
    reference = E.Reference(df, ["x1"], ["kind"])
    one = df.limit(1)
    rows = E.perturb(one, reference, 4000, [0]).toPandas()
    first = rows[rows["_sample"] == 0].iloc[0]
    source = one.first()
    assert (first["x1"], first["kind"], list(first["_same"])) == (source["x1"], source["kind"], [1.0, 1.0])
    share = df.filter("kind = 'p'").count() / df.count()
    assert (rows["kind"] == "p").mean() == pytest.approx(share, abs=0.03)
    assert rows["x1"].median() == pytest.approx(df.approxQuantile("x1", [0.5], 0.0)[0], abs=0.1)


def test_queries_search_whole_grids():
    from rankfold.plans import fitting

    grids = {key: spec.grid for key, spec in fitting.specs().items()}
    assert [len(g) for g in grids.values()] == [3, 3, 9, 4, 3, 1]
    assert {spec.estimator.getMaxIter() for key, spec in fitting.specs().items() if key in ("LR", "SVM")} == {100}
    assert {p.name: v for p, v in grids["RF"][-1].items()} == {"numTrees": 100, "maxDepth": 15}


@pytest.mark.parametrize("key, params", [("DT", {"maxDepth": 4}), ("RF", {"numTrees": 7, "maxDepth": 5}), ("GB", {"maxIter": 6, "maxDepth": 3})])
def test_stored_nodes_restate_tree_scores(spark, data, tmp_path, key, params, monkeypatch):
    monkeypatch.setattr(T, "LEVEL_NODES", 2)  # deeper levels are joined without a broadcast
    _, train, test, _ = data
    spec = L.model_specs()[key]
    model = L.refit(spec, params, train)
    model.write().overwrite().save(str(tmp_path / "model"))
    nodes = T.node_table(spark, str(tmp_path / "model"))
    want = {r["id"]: r["score"] for r in L.score(model, test, spec.score_column).collect()}
    got = {r["id"]: r["score"] for r in T.tree_scores(test, nodes, key == "GB").collect()}
    assert got.keys() == want.keys() and [got[i] for i in got] == pytest.approx([want[i] for i in got], abs=1e-12)
    if key == "DT":
        for r in T.leaf_counts(train, nodes).collect():
            assert [r["negatives"], r["positives"]] == r["stored"]
    if key != "GB":
        importance = {r["feature"]: r["importance"] for r in T.gain_importance(nodes).collect()}
        assert [importance.get(i, 0.0) for i in range(len(model.featureImportances))] == pytest.approx(list(model.featureImportances.toArray()), abs=1e-12)


def test_certificates_tell_the_optimum_from_other_points(data):
    _, train, test, _ = data
    lr = L.refit(L.model_specs()["LR"], {"regParam": 1e-2}, train)
    svm = L.refit(L.model_specs()["SVM"], {"regParam": 1e-2}, train)
    assert T.logistic_certificate(lr, train) < 1e-4 and T.hinge_certificate(svm, train) < 1e-3
    early = L.model_specs(max_iter=1)
    assert T.logistic_certificate(L.refit(early["LR"], {"regParam": 1e-2}, train), train) > 1e-2
    assert T.hinge_certificate(L.refit(early["SVM"], {"regParam": 1e-2}, train), train, step=0.05) > 1e-3
    for model, column in ((lr, "probability"), (svm, "rawPrediction")):
        m = T.margin(model)
        stated = test.select("id", (m if model is svm else 1 / (1 + F.exp(-m))).alias("again"))
        both = L.score(model, test, column).join(stated, "id")
        assert both.filter("abs(score - again) > 1e-9").count() == 0


def _vectors(spark, n=600):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") * 7919 % 1000 / 1000).alias("a"), (F.col("id") * 104729 % 997 / 997).alias("b"))
    x = array_to_vector(F.array("a", "b", F.col("a") * F.col("b")))
    return rows.select("id", ((F.col("a") + F.col("b") * F.col("b")) > 0.9).cast("int").alias("default"), (F.col("id") % 3).cast("int").alias("fold"),
                       x.alias("features"), x.alias("features_sc")).coalesce(2).cache()


def test_fewer_rounds_are_the_beginning_of_more(spark, monkeypatch, tmp_path):
    """Grid points that differ in rounds only share a fit a fold; their figures are those of fits of their own."""
    from pyspark.ml.classification import GBTClassifier
    from rankfold.operators import models, search

    train = _vectors(spark)
    spec = models.model_specs(boost_rounds=[3, 6], boost_depths=[2, 3])["GB"]
    assert sorted(map(sorted, search.families(spec.estimator, spec.grid).values())) == [[0, 2], [1, 3]]
    fits, fit = [], GBTClassifier._fit_java
    monkeypatch.setattr(GBTClassifier, "_fit_java", lambda self, rows: fits.append(self.getMaxIter()) or fit(self, rows))
    judge = models.evaluator("probability")
    found = search.fold_search(spec, train, judge)
    assert sorted(fits)[:-1] == [6] * 6 or sorted(fits)[1:] == [6] * 6  # and the refit of the best point
    for g, point in enumerate(spec.grid):
        own = [spec.estimator.copy(point).fit(train.filter(f"fold <> {k}")) for k in range(3)]
        assert found.means[g] == pytest.approx(sum(judge.evaluate(m.transform(train.filter(f"fold = {k}"))) for k, m in enumerate(own)) / 3, abs=1e-12)
    long = spec.estimator.copy({spec.estimator.maxIter: 6}).fit(train)
    short = spec.estimator.copy({spec.estimator.maxIter: 3})
    cut, again = search.first_rounds(long, short), short.fit(train)
    assert (cut.getNumTrees, cut.treeWeights) == (again.getNumTrees, again.treeWeights) and cut.toDebugString.split("\n", 1)[1] == again.toDebugString.split("\n", 1)[1]
    cut.write().overwrite().save(f"{tmp_path}/cut")
    stored = search.ModelStore(spark, str(tmp_path)).load(f"{tmp_path}/cut")
    assert stored.getNumTrees == 3 and T.node_table(spark, f"{tmp_path}/cut").select("tree").distinct().count() == 3
    for model in (cut, stored):
        assert models.score(model, train, "probability").exceptAll(models.score(again, train, "probability")).isEmpty()


def test_forests_keep_node_ids_and_stay_as_they_were(spark):
    from rankfold.operators import models

    estimator = models.model_specs()["RF"].estimator
    assert estimator.getCacheNodeIds()
    deep = {estimator.maxDepth: 6, estimator.numTrees: 5}
    train = _vectors(spark)
    kept, plain = (estimator.copy({**deep, estimator.cacheNodeIds: c}).fit(train) for c in (True, False))
    assert kept.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]


def test_a_search_holds_only_what_its_fits_read(spark):
    from pyspark import StorageLevel
    from rankfold.operators import models, search

    train, specs = _vectors(spark), models.model_specs()
    assert search.columns_read(specs["NB"].estimator, train, "fold") == ["default", "fold", "features"]
    assert search.columns_read(specs["SVM"].estimator, train, "fold") == ["default", "fold", "features_sc"]
    assert search._level(specs["LR"].estimator) == StorageLevel.MEMORY_ONLY


def test_a_session_prepares_its_rows_once(spark, monkeypatch):
    """The scaled vector follows from the stored one; a second query of the session reads no fingerprint again."""
    from rankfold.plans import fitting

    sf = "/root/testdata/sf0.001"
    train, test, fitted, *_, rows = fitting.prepared(spark, sf)
    assert train.columns[-2:] == ["features", "features_sc"] == test.columns[-2:]
    stored = spark.read.parquet(fitting.ModelStore(spark).place("prepared", rows, ",".join(fitting.S.FEATURES)) + "/train")
    assert "features_sc" not in stored.columns
    monkeypatch.setattr(fitting, "rows_fingerprint", lambda df: 1 / 0)
    assert fitting.prepared(spark, sf)[0] is train
