"""Grid search over stored folds that keeps the fold models of the winning parameters, and a store of finished searches.

The models a search fits for each fold are those that out-of-fold scores need, so nothing is fitted again for them. Of
each grid point the fold models are held only until a better point is known. Grid points that differ only in their number of boosting
rounds share one fit a fold: boosting with fewer rounds is the beginning of the longer one.

A finished search lies below the shared folder, in a place named by a fingerprint of the training rows, the estimator's
parameters and the grid. Its record is written last and marks it as finished; a search whose rows or grid differ has
another place. Any session that shares the folder goes on from there without fitting.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from threading import Lock

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankfold.operators import growing
from rankfold.session import shared_folder
from rankfold.sources.files import read_record, write_record

#: Training rows of a partition during a search: trees and gradients pass over the rows once a level or step, and the
#: tasks' own cost prevails where partitions are small. Beyond one partition a core they get ten times as large, and no larger,
#: so that what a task holds doesn't grow with the table.
ROWS_PER_PARTITION = 10_000
#: Fits that run side by side at most.
MOST_AT_ONCE = 8


@dataclass(frozen=True)
class Search:
    """Fold AUCs of every grid point, the best point, its model of all rows and its models without each fold."""

    means: list[float]
    deviations: list[float]
    best: int
    model: Model | None
    fold_models: list[Model]
    place: str | None = None  # where it is stored: `best`, `fold_<k>` and `record`


def compact(train: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> tuple[DataFrame, int]:
    """The rows in partitions worth a task, kept in memory and on disk; and how many fits may run side by side.

    A fit waits for its driver between steps, so cores are dealt to several fits where a fit has few partitions.
    """
    spark = train.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = train.count()
    partitions = max(1, min(-(-rows // rows_per_partition), max(cores, -(-rows // (10 * rows_per_partition)))))
    return train.coalesce(partitions).persist(level), max(2, min(MOST_AT_ONCE, 4 * cores // partitions))


def columns_read(estimator: Estimator, train: DataFrame, *further: str) -> list[str]:
    """Columns that a fit of the estimator reads, with `further`; all where a stage doesn't name what it reads."""
    names = set(further)
    for stage in estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]:
        mine = {stage.getOrDefault(p) for p in ("featuresCol", "labelCol", "weightCol", "inputCol") if stage.hasParam(p) and stage.isDefined(p)}
        if not any(stage.hasParam(p) and stage.isDefined(p) for p in ("featuresCol", "inputCol")):
            return train.columns
        names |= mine
    return [c for c in train.columns if c in names]


def _level(estimator: Estimator) -> StorageLevel:
    """Linear models keep rows as blocks of their own, for which the held ones make room; what is dropped is read again."""
    last = estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator
    return StorageLevel.MEMORY_ONLY if isinstance(last, (LogisticRegression, LinearSVC)) else StorageLevel.MEMORY_AND_DISK


def families(estimator: Estimator, grid: list) -> dict[int, list[int]]:
    """Grid points by the point whose fit serves them: boosting with equal other parameters is fitted once, with most rounds."""
    if not isinstance(estimator, GBTClassifier):
        return {g: [g] for g in range(len(grid))}
    groups: dict[str, list[int]] = {}
    for g, point in enumerate(grid):
        others = sorted((p.name, str(v)) for p, v in point.items() if p.name != "maxIter")
        groups.setdefault(json.dumps(others), []).append(g)
    rounds = lambda g: estimator.copy(grid[g]).getMaxIter()
    return {max(members, key=rounds): members for members in groups.values()}


def first_rounds(model: Model, estimator: GBTClassifier) -> Model:
    """The model that `estimator`, with fewer rounds and else alike, fits on the same rows: the first trees of `model`."""
    whole, jvm, n = model._java_obj, SparkSession.active()._jvm, estimator.getMaxIter()
    ml, array = jvm.org.apache.spark.ml, type(model)._new_java_array
    trees = array(list(whole.trees())[:n], ml.regression.DecisionTreeRegressionModel)
    weights = array(list(whole.treeWeights())[:n], jvm.double)
    made = ml.classification.GBTClassificationModel(whole.uid(), trees, weights, whole.numFeatures(), whole.numClasses())
    return estimator._copyValues(type(model)(made))


def grows_here(estimator: Estimator, grid: list, rows: DataFrame) -> bool:
    """Whether `growing` fits the rows: they are many, and the estimator and grid ask for nothing that it lacks."""
    return growing.suits(estimator, grid, rows) and rows.count() >= growing.from_rows(estimator)


def fit(estimator: Estimator, rows: DataFrame) -> Model:
    """One fit, by the same way as those of a search."""
    if not grows_here(estimator, [{}], rows):
        return estimator.fit(rows)
    read = columns_read(estimator, rows, estimator.getLabelCol())
    held, _ = compact(rows.select(*read, growing.row_key(rows).alias(growing.KEY)))
    try:
        return growing.fit(estimator, held)
    finally:
        held.unpersist()


def fold_search(spec, train: DataFrame, evaluator, folds: int = 3, fold: str = "fold", refit: bool = True, parallelism: int | None = None) -> Search:
    """Fits every grid point without each fold; ties of the mean go to the first point.

    `spec` has an estimator and a grid; `evaluator` judges the predictions for the fold that was left out.
    """
    read = columns_read(spec.estimator, train, fold, evaluator.getLabelCol())
    if grows_here(spec.estimator, spec.grid, train):
        held, _ = compact(train.select(*read, growing.row_key(train).alias(growing.KEY)))
        try:
            values, best, model, models = growing.search(spec.estimator, spec.grid, held, evaluator, folds, fold, refit)
        finally:
            held.unpersist()
        return Search(values.mean(axis=1).tolist(), values.std(axis=1).tolist(), best, model, models)
    held, side_by_side = compact(train.select(*read), level=_level(spec.estimator))
    values, models, state, lock = np.full((len(spec.grid), folds), np.nan), {}, {"best": None}, Lock()
    served = families(spec.estimator, spec.grid)

    def fit(job: tuple[int, int]) -> None:
        leader, k = job
        whole = spec.estimator.copy(spec.grid[leader]).fit(held.filter(F.col(fold) != k))
        for g in served[leader]:
            model = whole if g == leader else first_rounds(whole, spec.estimator.copy(spec.grid[g]))
            keep(g, k, model, evaluator.evaluate(model.transform(held.filter(F.col(fold) == k))))

    def keep(g: int, k: int, model: Model, value: float) -> None:
        with lock:
            values[g, k] = value
            models[g, k] = model
            if not np.isnan(values[g]).any():  # a whole point: it or the best one so far goes
                rank = lambda p: (values[p].mean(), -p)
                if state["best"] is None or rank(g) > rank(state["best"]):
                    state["best"], g = g, state["best"]
                for j in range(folds):
                    models.pop((g, j), None)

    try:
        # All folds of a point follow one another, so few points are open at a time.
        jobs = [(g, k) for g in served for k in range(folds)]
        with ThreadPoolExecutor(parallelism or side_by_side) as pool:
            list(pool.map(inheritable_thread_target(held.sparkSession)(fit), jobs))
        best = state["best"]
        model = spec.estimator.copy(spec.grid[best]).fit(held) if refit else None
    finally:
        held.unpersist()
    return Search(values.mean(axis=1).tolist(), values.std(axis=1).tolist(), best, model, [models[best, k] for k in range(folds)])


def fold_scores(search: Search, train: DataFrame, score, fold: str = "fold") -> DataFrame:
    """Every training row scored, by `score(model, rows)`, with the search's model that did not see its fold."""
    return reduce(DataFrame.unionByName, [score(m, train.filter(F.col(fold) == k)) for k, m in enumerate(search.fold_models)])


def rows_fingerprint(df: DataFrame) -> str:
    """Same for the same rows in any order or layout; one aggregation."""
    h = F.xxhash64(*df.columns)
    got = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).first()
    return f"{got['n']}:{got['x']}:{got['s']}:{','.join(df.columns)}"


def described(estimator: Estimator, grid: list) -> str:
    """Class, parameters and grid as text."""
    values = {p.name: v for p, v in estimator.extractParamMap().items() if isinstance(v, (str, int, float, bool, list))}
    points = [sorted((p.name, v) for p, v in point.items()) for point in grid]
    return json.dumps([type(estimator).__name__, values, points], sort_keys=True, default=str)


RECORD = "means array<double>, deviations array<double>, best int, folds int"


class ModelStore:
    """Fitted models below `folder`, or below the session's shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/rankfold-models"

    def place(self, *parts: str) -> str:
        return f"{self.folder}/{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:32]}"

    def search(self, spec, train: DataFrame, evaluator, folds: int = 3, rows: str | None = None, parallelism: int | None = None) -> Search:
        """The finished search of these rows and this grid, or a new one, which is then stored.

        `rows` may be the known fingerprint of the training rows.
        """
        place = self.place(rows or rows_fingerprint(train), described(spec.estimator, spec.grid), evaluator.getMetricName(), str(folds))
        found = read_record(self.spark, f"{place}/record", RECORD)
        if found is None:
            made = fold_search(spec, train, evaluator, folds, parallelism=parallelism)
            for name, model in [("best", made.model), *((f"fold_{k}", m) for k, m in enumerate(made.fold_models))]:
                if not growing.copied(model, f"{place}/{name}"):
                    model.write().overwrite().save(f"{place}/{name}")
            row = (made.means, made.deviations, made.best, folds)
            write_record(self.spark.createDataFrame([row], RECORD), f"{place}/record")
            return replace(made, place=place)
        record = found.first()
        return Search(list(record["means"]), list(record["deviations"]), record["best"], self.load(f"{place}/best"),
                      [self.load(f"{place}/fold_{k}") for k in range(record["folds"])], place)

    def load(self, path: str) -> Model:
        """A stored model of any class."""
        return DefaultParamsReader.loadParamsInstance(path, self.spark.sparkContext)
