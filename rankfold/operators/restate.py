"""Fitted models as tables: scores, leaf counts and importances worked out again from what a model has stored.

Nodes of a tree model are read from its stored files. Rows are routed level by level, each level by one join with the nodes of that
level, and end with their leaf. Linear models are stated by their coefficients, and a certificate tells how far they are
from the optimum of their own objective, by one aggregation over the training rows.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankfold.session import materialize

#: Nodes of a level that may be broadcast; the upper levels, where rows are gathered in few nodes, are always smaller.
LEVEL_NODES = 100_000
LEAF = -1


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """`(tree, weight, node, left, right, feature, values, categories, gain, weighted, stats, prediction)` of a stored tree model."""
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(weights, "tree")
    else:
        data = data.withColumns({"tree": F.lit(0), "weight": F.lit(1.0)})
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return materialize(data.select(
        "tree", "weight", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("values"),
        F.col("split.numCategories").alias("categories"), "gain", total.alias("weighted"), F.col("impurityStats").alias("stats"), "prediction"))


def _levels(nodes: DataFrame):
    """Inner nodes by depth, from the roots on, with their number."""
    at = nodes.filter("node = 0")
    while True:
        inner = materialize(at.filter(F.col("left") != LEAF))
        size = inner.count()
        if not size:
            return
        yield inner, size
        below = inner.select("tree", F.explode(F.array("left", "right")).alias("node"))
        at = nodes.join(below, ["tree", "node"])


def to_leaves(rows: DataFrame, nodes: DataFrame, features: str = "features", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """`(*keep, tree, weight, node, stats, prediction)`: the leaf of every row in every tree."""
    roots = nodes.filter("node = 0").select("tree", "weight")
    trees = F.array_sort(F.collect_list(F.struct("tree", "weight")))
    listed = roots.agg(trees.alias("_trees")).withColumn("_k", F.lit(1))  # one row, as long as the model has trees
    state = rows.select(*keep, vector_to_array(F.col(features)).alias("_x"), F.lit(1).alias("_k")).join(F.broadcast(listed), "_k")
    state = state.select(*keep, "_x", F.inline("_trees")).withColumn("node", F.lit(0))
    for inner, size in _levels(nodes):
        level = inner.select("tree", "node", "feature", "values", "categories", "left", "right")
        met = state.join(F.broadcast(level) if size <= LEVEL_NODES else level, ["tree", "node"], "left")
        value = F.get("_x", F.col("feature"))
        goes_left = F.when(F.col("categories") < 0, value <= F.get("values", F.lit(0))).otherwise(F.array_contains("values", value))
        state = met.select(*keep, "_x", "tree", "weight", F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(
            F.col("right")).alias("node"))
    leaves = nodes.filter(F.col("left") == LEAF).select("tree", "node", "stats", "prediction")
    return state.drop("_x").join(leaves, ["tree", "node"]).select(*keep, "tree", "weight", "node", "stats", "prediction")


def tree_scores(rows: DataFrame, nodes: DataFrame, boosted: bool, features: str = "features", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """`(*keep, score)`: mean class share of the leaves, or the logistic curve of the weighted sum of their predictions."""
    leaves = to_leaves(rows, nodes, features, keep)
    share = F.get("stats", F.lit(1)) / F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    value = 1 / (1 + F.exp(-2 * F.sum(F.col("weight") * F.col("prediction")))) if boosted else F.avg(share)
    return leaves.groupBy(*keep).agg(value.alias("score"))


def leaf_counts(train: DataFrame, nodes: DataFrame, label: str = "default", features: str = "features") -> DataFrame:
    """`(tree, node, negatives, positives, stored)` of the leaves that training rows reach, counted again beside the stored counts."""
    leaves = to_leaves(train, nodes, features, (label,))
    return leaves.groupBy("tree", "node").agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"),
                                              F.first("stats").alias("stored"))


def gain_importance(nodes: DataFrame) -> DataFrame:
    """`(feature, importance)` by index: gains weighted by rows, scaled to one in each tree, averaged over trees and scaled again."""
    per = nodes.filter(F.col("left") != LEAF).groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weighted")).alias("g"))
    totals = per.groupBy("tree").agg(F.sum("g").alias("t"))
    mean = per.join(totals, "tree").groupBy("feature").agg(F.sum(F.try_divide("g", "t")).alias("s"))
    every = mean.agg(F.sum("s").alias("w")).withColumn("_k", F.lit(1))
    return mean.withColumn("_k", F.lit(1)).join(F.broadcast(every), "_k").select("feature", (F.col("s") / F.col("w")).alias("importance"))


def margin(model: Model, features: str = "features_sc") -> Column:
    """Linear predictor of a fitted model."""
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    products = F.zip_with(vector_to_array(F.col(features)), weights, lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + F.lit(float(model.intercept))


def gaussian_score(model: Model, features: str = "features") -> Column:
    """Probability of the positive class from the class priors, means and variances of a Gaussian naive Bayes model."""
    theta, sigma, prior = model.theta.toArray(), model.sigma.toArray(), model.pi.toArray()

    def likelihood(k: int) -> Column:
        stated = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(v)).alias("v")) for m, v in zip(theta[k], sigma[k])])
        terms = F.zip_with(vector_to_array(F.col(features)), stated, lambda x, s: F.log(2 * F.pi() * s["v"]) + (x - s["m"]) * (x - s["m"]) / s["v"])
        return F.lit(float(prior[k])) - F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2

    return 1 / (1 + F.exp(likelihood(0) - likelihood(1)))


def logistic_certificate(model: Model, train: DataFrame, label: str = "default", features: str = "features_sc") -> float:
    """Largest absolute component of the gradient of the regularised mean log loss at the fitted coefficients, intercept included."""
    x = vector_to_array(F.col(features))
    rows = train.select(x.alias("x"), (1 / (1 + F.exp(-margin(model, features))) - F.col(label)).alias("e"))
    size = len(model.coefficients)
    sums = rows.agg(F.avg("e").alias("b"), *[F.avg(F.col("e") * F.get("x", F.lit(j))).alias(f"g{j}") for j in range(size)]).first()
    penalty = float(model.getRegParam())
    slope = [sums[f"g{j}"] + penalty * float(model.coefficients[j]) for j in range(size)]
    return max(abs(g) for g in [sums["b"], *slope])


def hinge_certificate(model: Model, train: DataFrame, step: float = 0.01, label: str = "default", features: str = "features_sc") -> float:
    """How much the regularised mean hinge loss could be lowered by a step along one coordinate, either way; by one aggregation."""
    size, penalty = len(model.coefficients), float(model.getRegParam())
    rows = train.select(vector_to_array(F.col(features)).alias("x"), margin(model, features).alias("m"), (2 * F.col(label) - 1).cast("double").alias("s"))
    loss = lambda move: F.avg(F.greatest(F.lit(0.0), 1 - F.col("s") * (F.col("m") + move)))
    moves = [loss(sign * step * F.get("x", F.lit(j))).alias(f"f{j}_{i}") for j in range(size) for i, sign in enumerate((1.0, -1.0))]
    got = rows.agg(loss(F.lit(0.0)).alias("here"), loss(F.lit(step)).alias("up"), loss(F.lit(-step)).alias("down"), *moves).first()
    lowered = [got["here"] - got["up"], got["here"] - got["down"]]
    for j in range(size):
        w = float(model.coefficients[j])
        for i, sign in enumerate((1.0, -1.0)):
            lowered.append(got["here"] - got[f"f{j}_{i}"] + penalty / 2 * (w * w - (w + sign * step) ** 2))
    return max(0.0, *lowered)
