"""Six Spark ML classifiers with fixed folds: search, scores, thresholds, checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from rankfold.operators.features import prepare
from rankfold.operators.metrics import auc, first_best, multi_threshold_counts, with_search_f1
from rankfold.operators.ordering import exact_quantiles
from rankfold.operators.search import ModelStore, Search, fit, fold_search
from rankfold.session import materialize
from rankfold.sources.files import resume_record

# Search grids and model settings.
REG_PARAMS = [1e-6, 1e-5, 1e-4]
DEPTHS = [5, 10, 15]
FOREST_TREES = [10, 50, 100]
BOOST_ROUNDS = [50, 100]
BOOST_DEPTHS = [3, 5]
MODEL_KEYS = ["LR", "DT", "RF", "GB", "SVM", "NB"]


@dataclass(frozen=True)
class Spec:
    estimator: Estimator
    grid: list
    score_column: str

    @property
    def default_threshold(self) -> float:
        return 0.5 if self.score_column == "probability" else 0.0


def model_specs(label: str = "default", seed: int = 42, max_memory_mb: int = 64, max_bins: int = 32,
                reg_params=REG_PARAMS, depths=DEPTHS, forest_trees=FOREST_TREES, boost_rounds=BOOST_ROUNDS,
                boost_depths=BOOST_DEPTHS, max_iter: int = 100) -> dict[str, Spec]:
    """Estimator, parameter grid and score column of each model.

    Linear models read the standardised vector, trees and naive Bayes the plain one.
    """
    scaled = dict(labelCol=label, featuresCol="features_sc", maxIter=max_iter, standardization=False)
    tree = dict(labelCol=label, featuresCol="features", maxBins=max_bins, maxMemoryInMB=max_memory_mb, seed=seed)
    lr = LogisticRegression(elasticNetParam=0.0, **scaled)
    svm = LinearSVC(**scaled)
    # Rows of a forest keep the node they have reached in each tree, instead of going down from the roots at every level.
    dt, rf = DecisionTreeClassifier(**tree), RandomForestClassifier(cacheNodeIds=True, **tree)
    gb = GBTClassifier(stepSize=0.1, **tree)
    nb = NaiveBayes(labelCol=label, featuresCol="features", modelType="gaussian")
    grids = {
        "LR": ParamGridBuilder().addGrid(lr.regParam, reg_params),
        "DT": ParamGridBuilder().addGrid(dt.maxDepth, depths),
        "RF": ParamGridBuilder().addGrid(rf.numTrees, forest_trees).addGrid(rf.maxDepth, depths),
        "GB": ParamGridBuilder().addGrid(gb.maxIter, boost_rounds).addGrid(gb.maxDepth, boost_depths),
        "SVM": ParamGridBuilder().addGrid(svm.regParam, reg_params),
        "NB": ParamGridBuilder(),
    }
    estimators = {"LR": lr, "DT": dt, "RF": rf, "GB": gb, "SVM": svm, "NB": nb}
    return {k: Spec(estimators[k], grids[k].build(), "rawPrediction" if k == "SVM" else "probability") for k in MODEL_KEYS}


def score_of(column: str):
    """Score of the positive class: second element of the output vector."""
    return vector_to_array(F.col(column))[1].alias("score")


def score(model: Model, df: DataFrame, score_column: str, label: str = "default", keep: list[str] | None = None,
          tasks: int | None = None) -> DataFrame:
    """`(id, y, score)`. `tasks` limits how many copies of a large model are in memory at once."""
    source = df if tasks is None else df.coalesce(tasks)
    return model.transform(source).select("id", F.col(label).alias("y"), *(keep or []), score_of(score_column))


def evaluator(score_column: str, label: str = "default", metric: str = "areaUnderROC") -> BinaryClassificationEvaluator:
    """Used for model selection only; reports use the exact metrics."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score_column, metricName=metric)


def cross_validate(spec: Spec, train: DataFrame, folds: int = 3, label: str = "default", store: ModelStore | None = None,
                   rows: str | None = None, parallelism: int | None = None) -> Search:
    """Grid search over the stored folds, best parameters refitted on all training rows; read from `store` where it is finished."""
    judge = evaluator(spec.score_column, label)
    if store is None:
        return fold_search(spec, train, judge, folds, parallelism=parallelism)
    return store.search(spec, train, judge, folds, rows, parallelism)


def grid_rows(spec: Spec, found: Search) -> list[dict]:
    return [{"params": {p.name: float(v) for p, v in grid.items()}, "mean_auc": mean, "sd_auc": sd}
            for grid, mean, sd in zip(spec.grid, found.means, found.deviations)]


GRID_SCHEMA = "model string, params map<string,double>, mean_auc double, sd_auc double, best boolean"


def cv_table(spark, model: str, spec: Spec, found: Search) -> DataFrame:
    """Parameters with mean and deviation of the fold AUCs; a grid is a handful of rows."""
    return spark.createDataFrame([(model, r["params"], r["mean_auc"], r["sd_auc"], i == found.best) for i, r in enumerate(grid_rows(spec, found))],
                                 GRID_SCHEMA)


def best_params(spec: Spec, found: Search) -> dict:
    return {p.name: v for p, v in spec.grid[found.best].items()}


def with_params(estimator: Estimator, params: dict) -> Estimator:
    """Copy of the estimator with parameters given by name (integers may arrive as floats)."""
    extra = {}
    for name, value in params.items():
        param = estimator.getParam(name)
        extra[param] = int(value) if isinstance(estimator.getOrDefault(param), int) else float(value)
    return estimator.copy(extra)


def refit(spec: Spec, params: dict, train: DataFrame) -> Model:
    return fit(with_params(spec.estimator, params), train)


def oof_scores(models: list[Model], train: DataFrame, score_column: str, label: str = "default") -> DataFrame:
    """Every training row scored by the model that did not see its fold: `(id, y, fold, score)`."""
    parts = [score(model, train.filter(F.col("fold") == k), score_column, label, keep=["fold"]) for k, model in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def oof_threshold(scores: DataFrame, score_column: str, points: int = 99) -> DataFrame:
    """`(threshold, f1)` that maximises F1 over stored out-of-fold scores `(y, fold, score)`.

    Probabilities use an even grid rounded to 4 digits; margins use quantiles of fold 0.
    """
    from rankfold.operators.metrics import evenly_spaced

    steps = evenly_spaced(0.02, 0.98, points)
    if score_column == "probability":
        grid = [round(s, 4) for s in steps]
    else:
        quantiles = exact_quantiles(scores.filter(F.col("fold") == 0), [], "score", steps)
        grid = sorted({row["quantile"] for row in quantiles.collect()})  # as many as there are points
    return first_best(with_search_f1(multi_threshold_counts(scores, [], grid)), [], "f1", "threshold").select("threshold", "f1")


RECORD = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("score_column", T.StringType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("auc_cv", T.DoubleType()), T.StructField("auc_cv_sd", T.DoubleType()),
    T.StructField("auc_test", T.DoubleType()), T.StructField("pr_auc_test", T.DoubleType()),
    T.StructField("default_threshold", T.DoubleType()), T.StructField("f1_threshold", T.DoubleType()),
    T.StructField("f1_oof", T.DoubleType()),
])


def run_model(key: str, spec: Spec, train: DataFrame, test: DataFrame, out: str, label: str = "default", folds: int = 3,
              store: ModelStore | None = None, rows: str | None = None, tasks: int | None = None) -> DataFrame:
    """Search, test scores, threshold and record of one model under the folder `out`.

    Writes `cv_<key>`, `scores_test_<key>` and `record_<key>`; a finished record is read
    back instead of training again. Scores go from executors to Parquet.
    """
    spark = train.sparkSession

    def compute() -> DataFrame:
        from rankfold.operators.metrics import ranking_metrics
        from rankfold.sources.files import write_parquet, write_record

        found = cross_validate(spec, train, folds, label, store, rows)
        write_record(cv_table(spark, key, spec, found), f"{out}/cv_{key}")
        path = f"{out}/scores_test_{key}"
        write_parquet(score(found.model, test, spec.score_column, label, tasks=tasks), path)
        ranks = ranking_metrics(spark.read.parquet(path), []).first()
        params = best_params(spec, found)
        cut = oof_threshold(materialize(oof_scores(found.fold_models, train, spec.score_column, label)), spec.score_column).first()
        record = (key, spec.score_column, {k: float(v) for k, v in params.items()}, found.means[found.best], found.deviations[found.best],
                  ranks["roc_auc"], ranks["average_precision"], spec.default_threshold, cut["threshold"], cut["f1"])
        return spark.createDataFrame([record], RECORD)

    return resume_record(spark, f"{out}/record_{key}", RECORD, compute)


def scaling_leak(train: DataFrame, label: str = "default", folds: int = 3, reg_params=REG_PARAMS, max_iter: int = 100) -> DataFrame:
    """CV AUC of logistic regression with the scaler fitted on all training rows vs inside each fold."""
    spark = train.sparkSession
    outside = LogisticRegression(labelCol=label, featuresCol="features_sc", maxIter=max_iter, standardization=False)
    scaler = StandardScaler(inputCol="features", outputCol="_fold_sc", withMean=True, withStd=True)
    lr = LogisticRegression(labelCol=label, featuresCol="_fold_sc", maxIter=max_iter, standardization=False)
    rows = []
    for name, estimator, param in (("all_train", outside, outside.regParam),
                                   ("inside_fold", Pipeline(stages=[scaler, lr]), lr.regParam)):
        spec = Spec(estimator, ParamGridBuilder().addGrid(param, reg_params).build(), "probability")
        found = fold_search(spec, train, evaluator("probability", label), folds, refit=False)
        rows.append((name, found.means[found.best], float(spec.grid[found.best][param])))
    return spark.createDataFrame(rows, "scaler string, auc_cv double, reg_param double")


def temporal_validation(spec: Spec, params: dict, features: DataFrame, split: DataFrame, period: str, last_train: int,
                        condition=None, label: str = "default", **columns) -> DataFrame:
    """Same test rows (the period after `last_train`) scored by a model of all periods and one of the past.

    `features` are rows of the model frame. Levels, encoder and scaler are learnt anew from the rows that each model is
    trained on, so the model of the past knows nothing of what came later.
    """
    condition = F.lit(True) if condition is None else condition
    placed = materialize(features.select("id", period, F.coalesce(condition, F.lit(False)).alias("_asked")).join(split, "id"))
    later = (F.col("split") == "test") & (F.col(period) == last_train + 1) & F.col("_asked")
    train = F.col("split") == "train"
    parts = []
    for name, learnt in (("all_periods", train), ("past_only", train & (F.col(period) <= last_train) & F.col("_asked"))):
        known, asked, *_ = prepare(features, placed.filter(learnt | later).select(*split.columns), label=label, **columns)
        parts.append(score(refit(spec, params, known), asked, spec.score_column, label).withColumn("trained_on", F.lit(name)))
    scores = materialize(parts[0].unionByName(parts[1]))
    sizes = scores.groupBy("trained_on").agg(F.count("*").alias("n_test"))
    return auc(scores, ["trained_on"]).join(sizes, "trained_on")


def impurity_importance(model: Model, features: DataFrame) -> DataFrame:
    """`(index, feature, importance)`: impurity importance by feature name; names come from the vector's own metadata."""
    attributes = features.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    values = model.featureImportances.toArray()
    rows = [(i, names.get(i, f"f{i}"), float(v)) for i, v in enumerate(values)]
    return features.sparkSession.createDataFrame(rows, "index int, feature string, importance double")

