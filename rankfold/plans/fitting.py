"""Classifiers, importances and explanations on the feature frame.

Every model is searched over its whole grid, once for a table and grid, and used with the parameters that won; finished
searches lie in the model store. Every query reads all resolved orders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from rankfold import schema as S
from rankfold.operators import explain as E
from rankfold.operators import features as X
from rankfold.operators import metrics as M
from rankfold.operators import models as L
from rankfold.operators import restate as T
from rankfold.operators.ordering import midranks_of
from rankfold.operators.report import joint_extremes
from rankfold.operators.search import ModelStore, rows_fingerprint
from rankfold.operators.split import hash_sample, make_split
from rankfold.plans.catalog import AUC_SQL, WIDE_SQL, curve_sql, query, rounded, wide
from rankfold.plans.features import FEATURES_SQL, stored_features
from rankfold.plans.splitting import SPLIT_SQL
from rankfold.plans.storage import _place
from rankfold.session import materialize
from rankfold.sources.files import read_parquet, read_record, write_parquet, write_record

def specs():
    return L.model_specs()


def framed(spark, sf):
    """`(frame, split)`: the stored feature frame and its partition table, for queries that learn levels and encoders themselves."""
    frame = stored_features(spark, sf)
    return frame, make_split(frame, "id", "default")


_PREPARED: dict[tuple[str, str], tuple] = {}


def prepared(spark, sf):
    """`(train, test, fitted pipeline, kept levels, frame, split, fingerprint)`, stored by the fingerprint of the feature frame.

    Every fit reads the vectors many times, and later sessions with the same rows read them on. A session looks once. The scaled
    vector is not stored, it follows from the other one where it is read.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key in _PREPARED:
        return _PREPARED[key]
    frame, split = framed(spark, sf)
    store = ModelStore(spark)
    rows = rows_fingerprint(frame)
    place = store.place("prepared", rows, ",".join(S.FEATURES))
    if read_record(spark, f"{place}/record", "rows string") is None:
        train, test, fitted, kept = X.prepare(frame, split, carry=["issue_year", "term_months"])
        for name, df in (("train", train.drop("features_sc")), ("test", test.drop("features_sc")), ("kept", kept)):
            write_parquet(df, f"{place}/{name}")
        fitted.write().overwrite().save(f"{place}/fitted")
        write_record(spark.createDataFrame([(rows,)], "rows string"), f"{place}/record")
    train, test, kept = (read_parquet(spark, f"{place}/{name}") for name in ("train", "test", "kept"))
    fitted = PipelineModel.load(f"{place}/fitted")
    scaler = fitted.stages[-1]
    _PREPARED[key] = scaler.transform(train), scaler.transform(test), fitted, kept, frame, split, rows
    return _PREPARED[key]


def searched(spark, sf, key: str):
    """Specification and finished search of a model; the specification is the one whose grid was searched."""
    train, *_, rows = prepared(spark, sf)
    spec = specs()[key]
    return spec, L.cross_validate(spec, train, store=ModelStore(spark), rows=rows)


def chosen(spark, sf, key: str) -> tuple[L.Spec, dict]:
    spec, found = searched(spark, sf, key)
    return spec, L.best_params(spec, found)


def _scores(key: str):
    def run(spark, sf) -> DataFrame:
        _, test, *_ = prepared(spark, sf)
        spec, found = searched(spark, sf, key)
        return L.score(found.model, test, spec.score_column)

    return run



# Gaussian naive Bayes has a closed form: class means and variances of numbers and level indicators.
FILLED_SQL = f"""{FEATURES_SQL}, {SPLIT_SQL},
filled AS (SELECT f.id, f."default" AS y, issue_year, is_test, fold, {', '.join(f'coalesce(f.{c}, -1) AS {c}' for c in S.NUMERIC)},
  {', '.join(S.CATEGORICAL)} FROM features f JOIN split s ON f.id = CAST(s.id AS VARCHAR))"""


#: Rows that are scored, with the word that the stated score is the model's.
AGREES_SQL = f"WITH {FILLED_SQL} SELECT id, y, TRUE AS agrees FROM filled WHERE is_test"


def _agreement(scores: DataFrame, restated: DataFrame) -> DataFrame:
    """`(id, y, agrees)`: whether the score is the one worked out from what the model has stored, to nine digits."""
    both = scores.join(restated.select("id", F.col("score").alias("again")), "id", "left")
    return both.select("id", "y", F.coalesce(F.abs(F.col("score") - F.col("again")) <= 1e-9, F.lit(False)).alias("agrees"))


def _stated(spark, key: str, model, path: str, rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """`(id, score)` from coefficients, class moments or the leaves that rows reach in the stored nodes; with `train`, leaves are counted again."""
    if key in ("LR", "SVM", "NB"):
        m = T.gaussian_score(model) if key == "NB" else T.margin(model)
        return rows.select("id", (1 / (1 + F.exp(-m)) if key == "LR" else m).alias("score"))
    nodes = T.node_table(spark, path)
    if train is not None:
        counted = T.leaf_counts(train, nodes).select("tree", "node", F.array("negatives", "positives").cast("array<double>").alias("again"))
        own = F.when(F.col("left") == T.LEAF, F.col("again")).otherwise(F.col("stats"))
        nodes = materialize(nodes.join(counted, ["tree", "node"], "left").withColumn("stats", own).drop("again"))
    return T.tree_scores(rows, nodes, key == "GB")


def _checked_scores(key: str):
    def run(spark, sf) -> DataFrame:
        """Test scores against those stated by what the model has stored; for the single tree, by training rows counted in its leaves."""
        train, test, *_ = prepared(spark, sf)
        spec, found = searched(spark, sf, key)
        stated = _stated(spark, key, found.model, f"{found.place}/best", test, train if key == "DT" else None)
        return _agreement(L.score(found.model, test, spec.score_column), stated)

    return run


for _name, _key in (("lr_scores", "LR"), ("svm_scores", "SVM"), ("dt_scores", "DT"), ("rf_scores", "RF"), ("gbt_scores", "GB")):
    query(_name, AGREES_SQL)(_checked_scores(_key))


#: Largest gradient component, and largest gain by a step along one coordinate, at which a fit counts as optimal.
GRADIENT_LIMIT, DESCENT_LIMIT = 1e-3, 1e-3


@query("linear_optimum", "SELECT 'LR' AS model, TRUE AS optimal UNION ALL SELECT 'SVM', TRUE")
def linear_optimum(spark, sf):
    """Whether the fitted linear models lie at the optimum of their own regularised losses, judged on all training rows."""
    train, *_ = prepared(spark, sf)
    lr, svm = (searched(spark, sf, key)[1].model for key in ("LR", "SVM"))
    rows = [("LR", T.logistic_certificate(lr, train) <= GRADIENT_LIMIT), ("SVM", T.hinge_certificate(svm, train) <= DESCENT_LIMIT)]
    return spark.createDataFrame(rows, "model string, optimal boolean")


def naive_bayes_sql(name: str, learn: str, ask: str, levels: str = "NOT is_test") -> str:
    """CTE `name`: `(id, y, fold, score)` of the rows `ask`, by moments over the rows `learn` and levels of the rows `levels`."""
    keep = ", ".join(f"""{name}_keep_{c} AS (SELECT {c} AS level FROM filled WHERE {levels} GROUP BY {c}
  HAVING count(*) >= 0.01 * (SELECT count(*) FROM filled WHERE {levels}))""" for c in S.CATEGORICAL)
    folded = ", ".join(f"CASE WHEN {c} IN (SELECT level FROM {name}_keep_{c}) THEN {c} ELSE '{S.RARE_LEVEL}' END AS {c}" for c in S.CATEGORICAL)
    own = "id, y, issue_year, term_months, is_test, fold"
    values = " UNION ALL ".join(
        [f"SELECT {own}, '{c}' AS v, CAST({c} AS DOUBLE) AS x FROM {name}_folded" for c in S.NUMERIC]
        + [f"""SELECT {own}, '{c}=' || level, CASE WHEN {c} = level THEN 1.0 ELSE 0.0 END::DOUBLE
  FROM {name}_folded, (SELECT DISTINCT {c} AS level FROM {name}_folded WHERE {levels})""" for c in S.CATEGORICAL])
    return f"""{keep},
{name}_folded AS (SELECT id, y, issue_year, is_test, fold, {', '.join(S.NUMERIC)}, {folded} FROM filled),
{name}_x AS ({values}),
{name}_eps AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(x) AS s FROM {name}_x WHERE {learn} GROUP BY v)),
{name}_moments AS (SELECT v, y AS k, avg(x) AS m, var_pop(x) + max(e) AS s FROM {name}_x, {name}_eps WHERE {learn} GROUP BY v, y),
{name}_prior AS (SELECT y AS k, ln(count(*)::DOUBLE) AS p FROM filled WHERE {learn} GROUP BY y),
{name}_sums AS (SELECT id, q.y, fold, k, sum(-0.5 * ln(2 * pi() * s) - (x - m) * (x - m) / (2 * s)) AS l
  FROM {name}_x q JOIN {name}_moments USING (v) WHERE {ask} GROUP BY id, q.y, fold, k),
{name} AS (SELECT id, y, fold, 1 / (1 + exp(max(l + p) FILTER (k = 0) - max(l + p) FILTER (k = 1))) AS score
  FROM {name}_sums JOIN {name}_prior USING (k) GROUP BY id, y, fold)"""


@query("nb_scores", f"WITH {FILLED_SQL}, {naive_bayes_sql('nb', 'NOT is_test', 'is_test')} SELECT id, y, round(score, 6) AS score FROM nb")
def nb_scores(spark, sf):
    return rounded(_scores("NB")(spark, sf), ["score"], 6)


NB_OOF_SQL = f"{FILLED_SQL}, " + ", ".join(
    naive_bayes_sql(f"nb{k}", f"(NOT is_test AND fold <> {k})", f"(NOT is_test AND fold = {k})") for k in range(3)) + (
    ", oof AS (" + " UNION ALL ".join(f"SELECT * FROM nb{k}" for k in range(3)) + ")")


@query("nb_oof_scores", f"WITH {NB_OOF_SQL} SELECT id, y, fold, round(score, 6) AS score FROM oof")
def nb_oof_scores(spark, sf):
    """Every training row scored by the naive Bayes model that did not see its fold."""
    train, *_ = prepared(spark, sf)
    found = searched(spark, sf, "NB")[1]
    return rounded(L.oof_scores(found.fold_models, train, "probability"), ["score"], 6)


# The fitted variances carry a billionth of the largest feature variance as smoothing.
@query("nb_class_moments", f"WITH {FEATURES_SQL}, {SPLIT_SQL}, tr AS (SELECT f.* FROM features f JOIN split s ON f.id = CAST(s.id AS VARCHAR) WHERE NOT is_test), "
       f"eps AS (SELECT 1e-9 * greatest({', '.join(f'var_pop(coalesce({c}, -1))' for c in S.NUMERIC)}) AS e FROM tr) "
       + " UNION ALL ".join(f"SELECT '{c}' AS variable, \"default\" AS y, round(avg(coalesce({c}, -1)), 4) AS mean, "
                            f"round(sqrt(var_pop(coalesce({c}, -1)) + max(e)), 4) AS sd "
                            "FROM tr, eps GROUP BY \"default\"" for c in ("loan_amnt", "annual_inc", "open_acc")))
def nb_class_moments(spark, sf):
    """Means and variances a fitted Gaussian naive Bayes model holds for each class."""
    train, *_ = prepared(spark, sf)
    model = L.refit(specs()["NB"], {}, train)
    names = ["loan_amnt", "annual_inc", "open_acc"]
    at = [S.NUMERIC.index(c) for c in names]
    theta, sigma = model.theta.toArray(), model.sigma.toArray()
    # Two classes by three variables, from the fitted model.
    rows = [(c, int(y), float(theta[y, i]), float(sigma[y, i]) ** 0.5) for c, i in zip(names, at) for y in (0, 1)]
    return rounded(spark.createDataFrame(rows, "variable string, y int, mean double, sd double"), ["mean", "sd"], 4)


@query("cv_grid_table")
def cv_grid_table(spark, sf):
    return reduce(DataFrame.unionByName, [L.cv_table(spark, key, *searched(spark, sf, key)) for key in L.MODEL_KEYS])


def _oof(spark, sf, key: str) -> tuple[L.Spec, DataFrame]:
    """Out-of-fold scores of a model with its best parameters, by the search's own fold models."""
    train, *_ = prepared(spark, sf)
    spec, found = searched(spark, sf, key)
    return spec, L.oof_scores(found.fold_models, train, spec.score_column)


@query("oof_scores", f"""WITH {FILLED_SQL} SELECT model, id, y, CAST(fold AS INTEGER) AS fold, TRUE AS agrees FROM filled,
  (VALUES {', '.join(f"('{k}')" for k in L.MODEL_KEYS)}) m(model) WHERE NOT is_test""")
def oof_scores(spark, sf):
    """Out-of-fold scores of all six models against those stated by their stored fold models."""
    train, *_ = prepared(spark, sf)
    parts = []
    for key in L.MODEL_KEYS:
        spec, found = searched(spark, sf, key)
        scores = L.oof_scores(found.fold_models, train, spec.score_column)
        for k, model in enumerate(found.fold_models):
            stated = _stated(spark, key, model, f"{found.place}/fold_{k}", train.filter(F.col("fold") == k))
            parts.append(_agreement(scores.filter(F.col("fold") == k), stated).select(F.lit(key).alias("model"), "id", "y", F.lit(k).alias("fold"), "agrees"))
    return reduce(DataFrame.unionByName, parts)


def _oof_cut(spark, sf, key: str) -> DataFrame:
    spec, scores = _oof(spark, sf, key)
    return L.oof_threshold(materialize(scores), spec.score_column)


@query("oof_threshold")
def oof_threshold(spark, sf):
    return reduce(DataFrame.unionByName, [_oof_cut(spark, sf, key).withColumn("model", F.lit(key)) for key in L.MODEL_KEYS])


@query("model_record")
def model_record(spark, sf):
    """Full run of every model: search, test scores, threshold, record; the second call resumes."""
    train, test, *_, rows = prepared(spark, sf)
    out, store = _place(spark, "models"), ModelStore(spark)
    for key, spec in specs().items():
        L.run_model(key, spec, train, test, out, store=store, rows=rows)
    return reduce(DataFrame.unionByName, [L.run_model(key, spec, train, test, out) for key, spec in specs().items()])


@query("scaling_leak_check")
def scaling_leak_check(spark, sf):
    train, *_ = prepared(spark, sf)
    return L.scaling_leak(train)


_LATER = "(is_test AND issue_year = 1999 AND term_months = 36)"
_PAST = "(NOT is_test AND issue_year <= 1998 AND term_months = 36)"


@query("temporal_validation_nb", f"""WITH {FILLED_SQL}, {naive_bayes_sql('every', 'NOT is_test', _LATER)}, {naive_bayes_sql('past', _PAST, _LATER, _PAST)},
both_sides AS (SELECT 'all_periods' AS trained_on, y, score FROM every UNION ALL SELECT 'past_only', y, score FROM past),
{curve_sql('both_sides', 'trained_on')}
SELECT trained_on, round({AUC_SQL}, 6) AS roc_auc, CAST(max(pos_total + neg_total) AS BIGINT) AS n_test FROM curve GROUP BY trained_on""")
def temporal_validation_nb(spark, sf):
    """Naive Bayes of all periods and of the past alone, levels and all learnt anew for each."""
    frame, split = framed(spark, sf)
    out = L.temporal_validation(specs()["NB"], {}, frame, split, "issue_year", 1998, F.col("term_months") == 36)
    return rounded(out.select("trained_on", "roc_auc", "n_test"), ["roc_auc"], 6)


@query("temporal_validation")
def temporal_validation(spark, sf):
    frame, split = framed(spark, sf)
    return L.temporal_validation(*chosen(spark, sf, "RF"), frame, split, "issue_year", 1998, F.col("term_months") == 36)


_FLAGS_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature" for c in S.NUMERIC]
    + [f"SELECT 'flags_of_{c}_' || level FROM (SELECT DISTINCT CASE WHEN {c} IN (SELECT level FROM imp_keep_{c}) THEN {c} ELSE '{S.RARE_LEVEL}' END AS level "
       "FROM filled WHERE NOT is_test UNION ALL SELECT '__unknown')" for c in S.CATEGORICAL])
_KEPT_SQL = ", ".join(f"""imp_keep_{c} AS (SELECT {c} AS level FROM filled WHERE NOT is_test GROUP BY {c}
  HAVING count(*) >= 0.01 * (SELECT count(*) FROM filled WHERE NOT is_test))""" for c in S.CATEGORICAL)


@query("impurity_importance", f"WITH {FILLED_SQL}, {_KEPT_SQL} SELECT feature, TRUE AS agrees FROM ({_FLAGS_SQL})")
def impurity_importance(spark, sf):
    """The forest's importances by feature name against those worked out from the gains of its stored nodes."""
    train, *_ = prepared(spark, sf)
    found = searched(spark, sf, "RF")[1]
    named = L.impurity_importance(found.model, train)
    again = T.gain_importance(T.node_table(spark, f"{found.place}/best"))
    both = named.join(again.select(F.col("feature").alias("index"), F.col("importance").alias("again")), "index", "left")
    return both.select("feature", (F.abs(F.col("importance") - F.coalesce("again", F.lit(0.0))) <= 1e-9).alias("agrees"))


def scoring_pipeline(spark, sf, key: str = "GB"):
    """Folding of levels, preprocessing and model as one transformer of raw rows, with train and test rows in their original levels."""
    _, _, fitted, kept, frame, split, _ = prepared(spark, sf)
    model = searched(spark, sf, key)[1].model
    rows = materialize(X.fill_sentinel(frame.join(split.select("id", "split"), "id"), S.NUMERIC))
    pipeline = PipelineModel(stages=[E.ModelInput(kept, S.NUMERIC, S.CATEGORICAL), fitted, model])
    return pipeline, rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")


#: A score that SQL can state, on model columns of very different weight.
STATED = "0.6 * m1 + 0.3 * m2 + 0.01 * m4"
STATED_COLUMNS = ["m1", "m2", "m4"]


def _shuffled_sql(column: str, repeat: int) -> str:
    """Scores with one column read from the row the repeat's distance further on."""
    distance = f"(1 + CAST(floor({E.text_uniform(f'42|{repeat}')!r} * (n - 1)) AS BIGINT))"
    score = " + ".join(f"{w} * {'d' if c == column else 'p'}.{c}" for c, w in (("m1", "CAST(0.6 AS DOUBLE)"), ("m2", "CAST(0.3 AS DOUBLE)"), ("m4", "CAST(0.01 AS DOUBLE)")))
    return f"SELECT '{column}' AS variable, {repeat} AS r, p.y, {score} AS score FROM placed p JOIN placed d ON d.pos = (p.pos + {distance.replace('(n - 1)', '(p.n - 1)')}) % p.n"


@query("permutation_stated", f"""WITH {WIDE_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY md5('43|' || id), id) - 1 AS pos, count(*) OVER () AS n FROM wide),
copies AS (SELECT 'intact' AS variable, 0 AS r, y, CAST(0.6 AS DOUBLE) * m1 + CAST(0.3 AS DOUBLE) * m2 + CAST(0.01 AS DOUBLE) * m4 AS score FROM wide
  UNION ALL {' UNION ALL '.join(_shuffled_sql(c, k) for c in STATED_COLUMNS for k in range(3))}),
{curve_sql('copies', 'variable, r')},
areas AS (SELECT variable, r, {AUC_SQL} AS a FROM curve GROUP BY variable, r),
drops AS (SELECT s.variable, i.a - s.a AS d FROM areas s, areas i WHERE i.variable = 'intact' AND s.variable <> 'intact')
SELECT variable AS "column", round(avg(d), 9) AS importance, round(stddev_pop(d), 9) AS sd, count(*) AS repeats FROM drops GROUP BY variable""")
def permutation_stated(spark, sf):
    """Importance of columns for a score that is a plain formula: the machinery of `permutation_importance` in full."""
    out = E.permutation_importance(E.StatedScore(STATED), wide(spark, sf), STATED_COLUMNS, "y")
    return rounded(out, ["importance", "sd"])


@query("permutation_importance")
def permutation_importance(spark, sf):
    pipeline, _, test = scoring_pipeline(spark, sf)
    return E.permutation_importance(pipeline, test, S.FEATURES, "default", repeats=3)


@query("local_surrogate")
def local_surrogate(spark, sf):
    """The two test rows that two models both get most wrong."""
    pipeline, train, test = scoring_pipeline(spark, sf)
    other = searched(spark, sf, "DT")[1].model
    first = L.score(pipeline, test, "probability")
    second = L.score(PipelineModel(stages=[*pipeline.stages[:2], other]), test, "probability")
    both = materialize(first.select("id", "y", F.col("score").alias("p1")).join(second.select("id", F.col("score").alias("p2")), "id"))
    ranked = midranks_of(both, "id", ["p1", "p2"], ("y",)).withColumn("pct", F.col("p1_pct") + F.col("p2_pct"))
    picked = joint_extremes(ranked, "p1", "p2", 0.5, 0.5).select("id", "kind")
    chosen = materialize(test.join(F.broadcast(picked), "id"))
    reference = E.Reference(train, S.NUMERIC, S.CATEGORICAL)
    return E.local_surrogate(pipeline, chosen, reference, samples=5000, top=10).join(chosen.select("id", "kind"), "id")


SAMPLES = 400
_DRAW = "CAST('0x' || substr(md5(o.id || '|42|' || k || '|{c}'), 1, 13) AS BIGINT) / 16.0::DOUBLE ** 13"
_KNOTS = ", ".join(f"{i / 20!r}::DOUBLE" for i in range(21))


def _numeric_draws_sql(c: str) -> str:
    at = f"(20 * ({_DRAW.format(c=c)}))"
    value = f"CASE WHEN k = 0 THEN o.{c} ELSE q[CAST(floor({at}) AS INTEGER) + 1] + (q[CAST(floor({at}) AS INTEGER) + 2] - q[CAST(floor({at}) AS INTEGER) + 1]) * ({at} - floor({at})) END"
    bins = "len(list_filter([q[6], q[11], q[16]], lambda x: x < {v}))"
    # Bounds that coincide count once or not at all on both sides, so repeats don't matter for equality.
    return f"""SELECT id, '{c}' AS variable, count(*) FILTER ({bins.format(v='v')} = {bins.format(v='own')}) AS same, round(avg(v), 6) AS mean, count(DISTINCT v) AS n_distinct FROM (
  SELECT o.id, CAST(o.{c} AS DOUBLE) AS own, q, {value} AS v FROM asked o, range({SAMPLES}) u(k), (SELECT quantile_cont(CAST({c} AS DOUBLE), [{_KNOTS}]) AS q FROM learnt)) GROUP BY id"""


def _level_draws_sql(c: str) -> str:
    return f"""SELECT d.id, '{c}', count(*) FILTER (level = own), NULL, count(DISTINCT level) FROM (
  SELECT o.id, k, o.{c} AS own, CAST(floor(({_DRAW.format(c=c)}) * (SELECT count(*) FROM learnt)) AS BIGINT) AS number FROM asked o, range({SAMPLES}) u(k)) d
  JOIN (SELECT {c} AS level, sum(count(*)) OVER (ORDER BY {c}) - count(*) AS low, sum(count(*)) OVER (ORDER BY {c}) AS high FROM learnt GROUP BY {c}) l
    ON CASE WHEN k = 0 THEN own = level ELSE number >= low AND number < high END GROUP BY d.id"""


@query("perturbed_rows", f"""WITH {FILLED_SQL}, learnt AS (SELECT * FROM filled WHERE NOT is_test),
asked AS (SELECT * FROM filled WHERE is_test ORDER BY md5('42|' || id), id LIMIT 3)
{' UNION ALL '.join([*map(_numeric_draws_sql, S.NUMERIC), *map(_level_draws_sql, S.CATEGORICAL)])}""")
def perturbed_rows(spark, sf):
    """What is drawn around three rows, by column: how often the row's own bin or level, the mean and the number of different values."""
    frame, split = framed(spark, sf)
    rows = materialize(X.fill_sentinel(frame.join(split.select("id", "split"), "id"), S.NUMERIC))
    reference = E.Reference(rows.filter("split = 'train'"), S.NUMERIC, S.CATEGORICAL)
    drawn = materialize(E.perturb(hash_sample(rows.filter("split = 'test'"), "id", 3), reference, SAMPLES, [42]))
    names = S.NUMERIC + S.CATEGORICAL
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.get("_same", F.lit(i)).alias("same"), (F.col(c).cast("double") if c in S.NUMERIC else F.lit(None).cast(
        "double")).alias("number"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)])
    return rounded(drawn.select("id", F.inline(cells)).groupBy("id", "variable").agg(
        F.sum("same").cast("long").alias("same"), F.avg("number").alias("mean"), F.count_distinct("value").alias("n_distinct")), ["mean"], 6)


@query("surrogate_stability")
def surrogate_stability(spark, sf):
    pipeline, train, test = scoring_pipeline(spark, sf)
    one = materialize(hash_sample(test, "id", 1))
    reference = E.Reference(train, S.NUMERIC, S.CATEGORICAL)
    return E.appearance_counts(E.local_surrogate(pipeline, one, reference, samples=5000, top=5, seeds=[0, 1, 2, 3, 4]))


@query("surrogate_global")
def surrogate_global(spark, sf):
    pipeline, train, test = scoring_pipeline(spark, sf)
    some = materialize(hash_sample(test, "id", 60))
    reference = E.Reference(train, S.NUMERIC, S.CATEGORICAL)
    return E.mean_absolute_weight(E.local_surrogate(pipeline, some, reference, samples=2000, top=len(S.FEATURES)))


@query("six_model_comparison")
def six_model_comparison(spark, sf):
    """Test metrics of all six models at the default and at the out-of-fold F1 threshold."""
    _, test, *_ = prepared(spark, sf)
    parts, points = [], []
    for key in L.MODEL_KEYS:
        spec, found = searched(spark, sf, key)
        parts.append(L.score(found.model, test, spec.score_column).withColumn("model", F.lit(key)))
        points.append((key, "default", spec.default_threshold))
        points.append((key, "oof_f1", _oof_cut(spark, sf, key).first()["threshold"]))
    scores = materialize(reduce(lambda a, b: a.unionByName(b), parts))
    thresholds = spark.createDataFrame(points, "model string, point string, threshold double")
    return M.operating_points(scores, thresholds, ["model"])
