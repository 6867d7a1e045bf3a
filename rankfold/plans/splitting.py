"""Split, folds and samples on the order table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import split as S
from rankfold.plans.catalog import BASE_SQL, base, query, rounded

SPLIT_SQL = BASE_SQL + """,
placed AS (
  SELECT id, y, md5('42|' || id) AS h, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || id), id) - 1 AS pos,
         CAST(ceil(count(*) OVER (PARTITION BY y) * 0.2) AS BIGINT) AS n_test FROM base),
split AS (
  SELECT id, y, CASE WHEN pos < n_test THEN 'test' ELSE 'train' END AS split,
         CASE WHEN pos < n_test THEN -1 ELSE (pos - n_test) % 3 END AS fold, pos < n_test AS is_test,
         CASE WHEN pos < n_test THEN -1
              ELSE row_number() OVER (PARTITION BY pos < n_test ORDER BY h, id) - 1 END AS rank FROM placed)"""


def _split(spark, sf):
    return S.make_split(base(spark, sf), "id", "y")


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT id, split, fold, is_test, rank FROM split")
def stratified_split(spark, sf):
    return _split(spark, sf)


@query("split_summary", f"""WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM split), 9) AS pct, round(avg(y), 9) AS positive_rate FROM split GROUP BY split""")
def split_summary(spark, sf):
    rows = base(spark, sf)
    return rounded(S.split_summary(_split(spark, sf).join(rows.select("id", "y"), "id"), ["split"], "y"), ["pct", "positive_rate"])


@query("fold_assignment", f"""WITH {SPLIT_SQL} SELECT fold, count(*) AS n_rows,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM split WHERE NOT is_test), 9) AS pct, round(avg(y), 9) AS positive_rate
FROM split WHERE NOT is_test GROUP BY fold""")
def fold_assignment(spark, sf):
    rows = base(spark, sf)
    train = _split(spark, sf).filter(~F.col("is_test"))
    return rounded(S.split_summary(train.join(rows.select("id", "y"), "id"), ["fold"], "y"), ["pct", "positive_rate"])


@query("nested_prefix", f"""WITH {SPLIT_SQL}, sizes AS (SELECT count(*) // 2 AS n FROM split WHERE NOT is_test)
SELECT id, fold, rank FROM split, sizes WHERE rank >= 0 AND rank < n""")
def nested_prefix(spark, sf):
    split = _split(spark, sf)
    half = split.filter(~F.col("is_test")).count() // 2
    return S.prefix_subset(split, half).select("id", "fold", "rank")


@query("split_overlap", f"""WITH {SPLIT_SQL} SELECT count(*) AS n_a, count(*) AS n_b, count(*) AS n_common FROM split WHERE is_test""")
def split_overlap(spark, sf):
    """The test side is the same however the rows are partitioned."""
    rows = base(spark, sf)
    a = S.make_split(rows.repartition(8), "id", "y").filter("is_test")
    b = S.make_split(rows.repartition(64), "id", "y").filter("is_test")
    return S.id_overlap(a, b)


@query("split_repeatability", f"""WITH {SPLIT_SQL} SELECT (SELECT count(*) FROM (FROM split EXCEPT ALL FROM split)) AS missing,
  (SELECT count(*) FROM (FROM split EXCEPT ALL FROM split)) AS extra""")
def split_repeatability(spark, sf):
    return S.table_difference(_split(spark, sf), S.make_split(base(spark, sf).repartition(13, "y"), "id", "y"))


@query("hash_sample", f"WITH {BASE_SQL} SELECT id, y FROM base ORDER BY md5('7|' || id), id LIMIT 500")
def hash_sample(spark, sf):
    return S.hash_sample(base(spark, sf).select("id", "y"), "id", 500, seed=7)


@query("fraction_sample", f"""WITH {BASE_SQL} SELECT id, y FROM base WHERE substr(md5('42|' || id), 1, 8) < '4ccccccc'
ORDER BY md5('42|' || id), id LIMIT 2000""")
def fraction_sample(spark, sf):
    return S.fraction_sample(base(spark, sf).select("id", "y"), "id", 0.3, 2000)


@query("random_positions", f"WITH {BASE_SQL} SELECT id, row_number() OVER (ORDER BY md5('5|' || id), id) - 1 AS position FROM base")
def random_positions(spark, sf):
    return S.hash_positions(base(spark, sf).select("id"), "id", 5)
