import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from rankfold.operators import growing as G
from rankfold.operators import models as L
from rankfold.operators import search


def _frame(spark, n, partitions=3):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.exponential(size=n).round(3) * (rng.random(n) < 0.5)
    k, m = rng.choice(["p", "q", "r"], n), rng.choice(["u", "v"], n)
    y = (a + 0.4 * b * (k == "q") - c + rng.normal(size=n) > 0.6).astype(int)
    raw = spark.createDataFrame(pd.DataFrame({"id": [f"r{i}" for i in range(n)], "default": y, "fold": (np.arange(n) % 3).astype("int32"), "a": a, "b": b, "c": c, "k": k, "m": m}))
    steps = [StringIndexer(inputCols=["k", "m"], outputCols=["ki", "mi"]), OneHotEncoder(inputCols=["ki", "mi"], outputCols=["kf", "mf"], dropLast=False),
             VectorAssembler(inputCols=["a", "kf", "b", "mf", "c"], outputCol="features")]
    rows = Pipeline(stages=steps).fit(raw).transform(raw).select("id", "default", "fold", "features")
    return rows.repartition(partitions, "id").withColumn(G.KEY, G.row_key(rows)).cache()


@pytest.fixture(scope="module")
def rows(spark):
    return _frame(spark, 4000)


def text(model):
    """Splits and predictions, these to nine digits."""
    return re.sub(r"(-?\d+\.\d{8,})(E-?\d+)?", lambda m: f"{float(m[0]):.9f}", model.toDebugString.split("\n", 1)[1])


def nodes(spark, model, path):
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    data = data.select("treeID", "nodeData.*") if "treeID" in data.columns else data.withColumn("treeID", F.lit(0))
    return data.orderBy("treeID", "id").toPandas()


@pytest.mark.parametrize("key, params", [("DT", {"maxDepth": 3}), ("DT", {"maxDepth": 9}), ("GB", {"maxIter": 4, "maxDepth": 3}), ("GB", {"maxIter": 7, "maxDepth": 5})])
def test_trees_and_boosting_are_those_of_spark(spark, rows, key, params, tmp_path, monkeypatch):
    """Node for node, whether nodes are counted over partitions or grown whole, and however often margins are stored."""
    monkeypatch.setattr(G, "WHOLE_ROWS", 300)
    monkeypatch.setattr(G, "BLOCK_ROWS", 500)
    monkeypatch.setattr(G, "STORED_ROUNDS", 3)
    estimator = L.with_params(L.model_specs()[key].estimator, params)
    want, got = estimator.fit(rows), G.fit(estimator, rows)
    assert text(got) == text(want) and type(got) is type(want)
    assert {p.name: v for p, v in got.extractParamMap().items()} == {p.name: v for p, v in want.extractParamMap().items()}
    a, b = nodes(spark, want, f"{tmp_path}/a"), nodes(spark, got, f"{tmp_path}/b")
    assert len(a) == len(b)
    for name in ("prediction", "impurity", "gain", "rawCount", "leftChild", "rightChild"):
        assert list(a[name]) == pytest.approx(list(b[name]), abs=1e-9), name
    for x, z in zip(a["impurityStats"], b["impurityStats"]):
        assert list(x) == pytest.approx(list(z), rel=1e-9, abs=1e-9)
    both = L.score(want, rows, "probability").join(L.score(got, rows, "probability").withColumnRenamed("score", "again"), "id")
    assert both.filter("abs(score - again) > 1e-9").isEmpty()


def test_forests_nest_and_do_not_depend_on_the_layout(spark, rows, monkeypatch):
    forest = L.model_specs()["RF"].estimator
    grid = [{forest.numTrees: n, forest.maxDepth: d} for n in (3, 6) for d in (2, 7)]
    bins, trees = G.grow({0: rows}, forest, grid)
    same = lambda x, z: all(np.array_equal(getattr(x, n), getattr(z, n)) for n in ("heap", "feature", "cut", "flip", "stats"))
    monkeypatch.setattr(G, "WHOLE_ROWS", 200)
    monkeypatch.setattr(G, "BLOCK_ROWS", 333)
    monkeypatch.setattr(G, "LEVEL_NODES", 5)
    monkeypatch.setattr(G, "DEALT_BYTES", 4000 * 20 * 4)
    for n, d in ((3, 2), (6, 7), (3, 7)):
        _, own = G.grow({0: rows.repartition(5)}, forest, [{forest.numTrees: n, forest.maxDepth: d}])
        assert len(own[0, d]) == n and all(same(x, z) for x, z in zip(own[0, d], trees[0, d]))
    assert max(int(G._depth(t.heap).max()) for t in trees[0, 7]) <= 7 and len({tuple(t.feature) for t in trees[0, 7]}) == 6
    w = G.weights(np.arange(200_000, dtype=np.uint64), 42, 3)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    asked = G.asked_features(np.arange(1, 20_001), 42, 0, 11, 4)
    assert asked.shape == (20_000, 4) and (np.diff(asked, axis=1) > 0).all()
    assert np.bincount(asked.ravel(), minlength=11) / 20_000 == pytest.approx(np.full(11, 4 / 11), abs=0.02)


def test_forests_are_as_good_as_those_of_spark(rows):
    spec = L.model_specs(forest_trees=[20], depths=[6])["RF"]
    learn, ask = rows.filter("fold <> 0"), rows.filter("fold = 0")
    estimator = spec.estimator.copy(spec.grid[0])
    judge = L.evaluator("probability")
    theirs, mine = (judge.evaluate(m.transform(ask)) for m in (estimator.fit(learn), G.fit(estimator, learn)))
    assert theirs > 0.8 and mine == pytest.approx(theirs, abs=0.02)


@pytest.mark.parametrize("key, grid", [("DT", {"depths": [2, 4]}), ("GB", {"boost_rounds": [2, 4], "boost_depths": [2, 3]}), ("RF", {"forest_trees": [3, 5], "depths": [2, 4]})])
def test_large_searches_grow_their_trees(spark, rows, key, grid, monkeypatch, tmp_path):
    """From `FROM_ROWS` rows on a search fits nothing by Spark; its figures are those of the models of each point."""
    train, spec = rows.drop(G.KEY), L.model_specs(**grid)[key]
    plain = L.cross_validate(spec, train)
    monkeypatch.setattr(G, "FROM_ROWS", 1000)
    monkeypatch.setattr(G, "FROM_ROWS_OTHERS", 1000)
    monkeypatch.setattr(type(spec.estimator), "_fit", lambda *_: 1 / 0)
    found = L.cross_validate(spec, train)
    judge = L.evaluator(spec.score_column)
    if key != "RF":
        assert found.means == pytest.approx(plain.means, abs=1e-9) and found.best == plain.best and text(found.model) == text(plain.model)
    own = [judge.evaluate(m.transform(rows.filter(f"fold = {k}"))) for k, m in enumerate(found.fold_models)]
    assert found.means[found.best] == pytest.approx(np.mean(own), abs=1e-9)
    again = L.refit(spec, L.best_params(spec, found), train)
    assert text(again) == text(found.model)
    stored = search.ModelStore(spark, str(tmp_path))
    L.cross_validate(spec, train, store=stored)
    monkeypatch.setattr(search, "fold_search", lambda *_, **__: 1 / 0)
    read = L.cross_validate(spec, train, store=stored)
    assert text(read.model) == text(found.model) and [text(m) for m in read.fold_models] == [text(m) for m in found.fold_models]


def test_what_growing_lacks_is_left_to_spark(rows):
    specs = L.model_specs()
    assert all(G.suits(specs[k].estimator, specs[k].grid, rows) == (k in ("DT", "RF", "GB")) for k in L.MODEL_KEYS)
    forest = specs["RF"].estimator
    for changed in (forest.copy({forest.subsamplingRate: 0.5}), forest.copy({forest.featureSubsetStrategy: "all"}), forest.copy({forest.impurity: "entropy"}),
                    forest.copy({forest.minInstancesPerNode: 3})):
        assert not G.suits(changed, specs["RF"].grid, rows)
    assert not G.suits(forest, [{forest.minInfoGain: 0.1}], rows) and not search.grows_here(forest, specs["RF"].grid, rows)


def test_held_partitions_do_not_grow_with_the_table(spark):
    """More rows than cores can hold in large partitions make more of them."""
    cores = spark.sparkContext.defaultParallelism
    held, _ = search.compact(spark.range(0, 80 * cores * 50, numPartitions=80 * cores), rows_per_partition=10)
    try:
        assert max(held.rdd.glom().map(len).collect()) <= 150 and held.rdd.getNumPartitions() == 40 * cores
    finally:
        held.unpersist()
