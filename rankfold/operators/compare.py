"""Paired comparison of score columns measured on the same rows.

Input is a wide score table `(id, y, one column per model)`; `to_wide` builds it from long
tables. Everything that leaves a function is one row per model or per pair of models.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankfold.functions.scalars import at_least, at_most, ratio
from rankfold.functions.tails import chi2_p, coin_p, normal_p
from rankfold.operators.metrics import score_distribution
from rankfold.operators.ordering import Distribution, lookup, midranks
from rankfold.session import materialize

ALPHA = 0.05
MARGIN = 0.005


def to_wide(scores: DataFrame, models: list[str], id_column: str = "id") -> DataFrame:
    """Long `(id, y, model, score)` to one column per model; one shuffle by id."""
    return scores.groupBy(id_column, "y").pivot("model", models).agg(F.first("score"))


def to_long(wide: DataFrame, models: list[str], keep: list[str] | None = None) -> DataFrame:
    return wide.unpivot(keep or ["id", "y"], models, "model", "score")


def score_join_check(base: DataFrame, other: DataFrame, id_column: str = "id") -> DataFrame:
    """Left join of two score tables: rows of each, missing scores, differing labels, surplus rows."""
    a = base.select(id_column, F.col("y").alias("_y"), F.lit(1).alias("_a"))
    b = other.select(id_column, F.col("y").alias("_y2"), F.col("score").alias("_s"), F.lit(1).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return a.join(b, id_column, "full").agg(
        F.count("_a").alias("n_base"), F.count("_b").alias("n_other"),
        F.count_if(F.col("_a").isNotNull() & F.col("_s").isNull()).alias("missing_score"),
        F.count_if(both & ~F.col("_y").eqNullSafe(F.col("_y2"))).alias("label_differs"),
        F.count_if(F.col("_a").isNull()).alias("surplus"),
    ).withColumn("identical", (F.col("n_base") == F.col("n_other"))
                 & (F.col("missing_score") + F.col("label_differs") + F.col("surplus") == 0))


def attach_scores(base: DataFrame, other: DataFrame, name: str, id_column: str = "id") -> DataFrame:
    """Left join that adds only the score of another table, under a new name."""
    return base.join(other.select(id_column, F.col("score").alias(name)), id_column, "left")


def components(wide: DataFrame, models: list[str]) -> DataFrame:
    """Structural components of each model's AUC, per row, as columns `c_<model>`.

    For a positive row: share of negatives it beats; for a negative row: share of positives
    that beat it; ties count one half. Both follow from the counts below a score. Each model
    reads only its own column and y, and rows then look their values up model by model.
    """
    sizes = wide.agg(*[F.approx_count_distinct(m).alias(m) for m in models]).first()

    def one(rows: DataFrame, model: str) -> DataFrame:
        found = score_distribution(wide.select("y", model), [], model, distinct=sizes[model])
        table = found.table.select(
            model, ((F.col("neg_below") + F.col("neg") / 2.0) / F.col("neg_total")).alias("_cp"),
            (1 - (F.col("pos_below") + F.col("pos") / 2.0) / F.col("pos_total")).alias("_cn"),
            (F.col("pos") + F.col("neg")).alias("n"), (F.col("pos_total") + F.col("neg_total")).alias("n_total"))
        mine = Distribution(table, (), model, ("n",), found.distinct)
        looked = lookup(rows, mine, {model: model}, ["_cp", "_cn"])
        return looked.withColumn(f"c_{model}", F.when(F.col("y") == 1, F.col("_cp")).otherwise(F.col("_cn"))).drop("_cp", "_cn")

    return reduce(one, models, wide.select("y", *models)).drop(*models)


def _moments(parts: DataFrame, models: list[str]) -> DataFrame:
    """Per class: count, mean component of each model and all sample covariances."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    return parts.groupBy("y").agg(
        F.count("*").cast("double").alias("n"),
        *[F.avg(f"c_{m}").alias(f"auc_{m}") for m in models],
        *[F.covar_samp(f"c_{a}", f"c_{b}").alias(f"cov_{a}__{b}") for a, b in pairs],
    )


def delong(wide: DataFrame, models: list[str], pairs: list[tuple[str, str]] | None = None,
           alpha: float = ALPHA) -> DataFrame:
    """Paired DeLong comparison: AUCs and their difference with intervals, z, p, correlation.

    Covariances of all models come from one aggregation over rows; pairs are then formed
    on two aggregated rows, so extra pairs cost nothing at row level.
    """
    return delong_table(_moments(components(wide, models), models), models, pairs, alpha)


def delong_table(moments: DataFrame, models: list[str], pairs: list[tuple[str, str]] | None = None,
                 alpha: float = ALPHA) -> DataFrame:
    pairs = list(combinations(models, 2)) if pairs is None else pairs
    order = {m: i for i, m in enumerate(models)}

    def scaled(a: str, b: str) -> Column:
        a, b = sorted((a, b), key=order.get)
        return F.sum(F.col(f"cov_{a}__{b}") / F.col("n"))

    def area(m: str) -> Column:
        return F.max(F.when(F.col("y") == 1, F.col(f"auc_{m}")))

    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), area(a).alias("auc1"),
                              area(b).alias("auc2"), scaled(a, a).alias("var1"), scaled(b, b).alias("var2"),
                              scaled(a, b).alias("cov")) for a, b in pairs])
    q = F.lit(NormalDist().inv_cdf(1 - alpha / 2))
    table = moments.agg(rows.alias("_rows")).select(F.inline("_rows"))
    se = F.sqrt(at_least(F.col("var1") + F.col("var2") - 2 * F.col("cov"), 0.0))
    return (
        table.withColumn("delta", F.col("auc1") - F.col("auc2")).withColumn("se", se)
        .withColumns({
            "auc1_lo": at_least(F.col("auc1") - q * F.sqrt("var1"), 0.0),
            "auc1_hi": at_most(F.col("auc1") + q * F.sqrt("var1"), 1.0),
            "auc2_lo": at_least(F.col("auc2") - q * F.sqrt("var2"), 0.0),
            "auc2_hi": at_most(F.col("auc2") + q * F.sqrt("var2"), 1.0),
            "delta_lo": F.col("delta") - q * F.col("se"), "delta_hi": F.col("delta") + q * F.col("se"),
            "z": F.when(F.col("se") > 0, ratio("delta", "se"))
                  .when(F.col("delta") == 0, F.lit(0.0)).when(F.col("se") == 0, F.lit(float("inf"))),
            "corr_auc": F.when(F.col("var1") * F.col("var2") > 0, ratio(F.col("cov"), F.sqrt(F.col("var1") * F.col("var2")))),
        })
        .withColumn("p_value", normal_p("z"))
        .select("model_a", "model_b", "auc1", "auc2", "auc1_lo", "auc1_hi", "auc2_lo", "auc2_hi", "delta",
                "delta_lo", "delta_hi", "se", "z", "p_value", "corr_auc")
    )


def auc_intervals(wide: DataFrame, models: list[str], alpha: float = ALPHA) -> DataFrame:
    """AUC and DeLong interval of each model."""
    table = delong(wide, models, [(m, m) for m in models], alpha)
    return table.select(F.col("model_a").alias("model"), F.col("auc1").alias("roc_auc"),
                        F.col("auc1_lo").alias("lo"), F.col("auc1_hi").alias("hi"))


def delong_by_ranks(wide: DataFrame, models: list[str]) -> DataFrame:
    """Same figures as `delong` by another route: mid-ranks of all rows less mid-ranks within the class.

    A row's rank among all less its rank in its own class counts the other class below it.
    """
    rows = wide.select("y", *models)
    for m in models:
        rows = midranks(midranks(rows, [], m, f"_all_{m}"), ["y"], m, f"_own_{m}")
    sizes = wide.groupBy("y").agg(F.count("*").alias("n"))
    other = {1: sizes.filter("y = 0").select("n").scalar(), 0: sizes.filter("y = 1").select("n").scalar()}
    parts = []
    for m in models:
        below = F.col(f"_all_{m}") - F.col(f"_own_{m}")
        parts.append(F.when(F.col("y") == 1, below / other[1]).otherwise(1 - below / other[0]).alias(f"c_{m}"))
    # Stored once: every covariance would otherwise repeat the lookups.
    return delong_table(_moments(materialize(rows.select("y", *parts)), models), models)


def holm(df: DataFrame, p: str, family: list[str], name: str = "p_holm") -> DataFrame:
    """Holm-adjusted p values. A family is a list of comparisons, one row each."""
    everyone = W.partitionBy(*family)
    ordered = everyone.orderBy(F.col(p).asc_nulls_last())
    step = (F.count(p).over(everyone) - F.row_number().over(ordered) + 1) * F.col(p)
    stepped = df.withColumn("_step", step)
    running = F.max("_step").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return stepped.withColumn(name, F.when(F.col(p).isNotNull(), F.least(running, F.lit(1.0)))).drop("_step")


def with_flags(df: DataFrame, p: str = "p_holm", delta: str = "delta", alpha: float = ALPHA,
               margin: float = MARGIN) -> DataFrame:
    return df.withColumn("significant", F.col(p) < alpha).withColumn("relevant", F.abs(delta) >= margin)


def delong_family(wide: DataFrame, models: list[str], pairs: list[tuple[str, str]] | None = None,
                  family: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Pair table with Holm adjustment and significance / relevance flags."""
    table = delong(wide, models, pairs)
    label = F.lit("all")
    for (a, b), name in (family or {}).items():
        label = F.when((F.col("model_a") == a) & (F.col("model_b") == b), F.lit(name)).otherwise(label)
    return with_flags(holm(table.withColumn("family", label), "p_value", ["family"]))


def pair_matrix(table: DataFrame, models: list[str], value: str, sign: int) -> DataFrame:
    """Square table from pair rows: `sign` -1 mirrors with opposite sign, +1 unchanged."""
    forward = table.select("model_a", "model_b", F.col(value).alias("_v"))
    mirrored = table.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"),
                            (sign * F.col(value)).alias("_v"))
    return forward.unionByName(mirrored).groupBy(F.col("model_a").alias("model")).pivot("model_b", models).agg(F.first("_v"))


def mcnemar(wide: DataFrame, pairs: list[tuple[str, str]], thresholds: dict[str, float]) -> DataFrame:
    """McNemar's test of the decisions `score >= threshold`, all pairs in one pass.

    Without discordant rows p is 1; below 25 of them the exact binomial test is used,
    otherwise chi-square with continuity correction.
    """
    right = {m: (F.col(m) >= F.lit(float(t))) == (F.col("y") == 1) for m, t in thresholds.items()}
    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                              F.count_if(right[a] & ~right[b]).alias("b"), F.count_if(~right[a] & right[b]).alias("c"))
                     for a, b in pairs])
    return mcnemar_table(wide.agg(rows.alias("_rows")).select(F.inline("_rows")))


def mcnemar_table(counts: DataFrame) -> DataFrame:
    """chi2, p and method from columns b and c."""
    n = F.col("b") + F.col("c")
    chi2 = (F.when(n == 0, F.lit(0.0))
            .when(n >= 25, ratio((F.abs(F.col("b") - F.col("c")) - 1) ** 2, n)))
    return (
        counts.withColumn("chi2", chi2)
        .withColumn("method", F.when(n == 0, "none").when(n < 25, "exact").otherwise("chi2"))
        .withColumn("p_value", F.when(n == 0, F.lit(1.0))
                    # Vectorised functions see every row, so the exact test gets nulls where it does not apply.
                    .when(n < 25, coin_p(F.when(n < 25, F.least("b", "c")), F.when(n < 25, n)))
                    .otherwise(chi2_p("chi2", F.lit(1.0))))
    )


def agreement(table: DataFrame, first: str, others: list[str]) -> DataFrame:
    """For each other test: on how many comparisons its flag equals that of `first`."""
    rows = F.array(*[F.struct(F.lit(o).alias("test"), F.count_if(F.col(first) == F.col(o)).alias("agree"),
                              F.count_if(F.col(first) != F.col(o)).alias("differ")) for o in others])
    return table.agg(rows.alias("_rows")).select(F.inline("_rows"))


def disagreements(table: DataFrame, first: str, others: list[str]) -> DataFrame:
    return table.filter(reduce(lambda a, b: a | b, [F.col(first) != F.col(o) for o in others]))
