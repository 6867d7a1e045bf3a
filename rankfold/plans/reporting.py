"""Report tables: curves over volume, fits, medians, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.functions.scalars import interval_label, quartile_label
from rankfold.operators import explain as E
from rankfold.operators import report as R
from rankfold.plans.catalog import query, r, rounded, table


def curves(spark, sf):
    """Three cost curves over volume: per line count of an order, mean price, quantity and charge."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("qty"), F.max("l_extendedprice").alias("top"))
    return {name: lines.groupBy("n_lines").agg(F.avg(c).alias("cost")) for name, c in (("price", "price"), ("qty", "qty"), ("top", "top"))}


CURVES_SQL = """per_order AS (SELECT l_orderkey, count(*) AS n_lines, avg(l_extendedprice) AS price, avg(l_quantity) AS qty, max(l_extendedprice) AS top
  FROM lineitem GROUP BY l_orderkey),
curves AS (SELECT n_lines, avg(price) AS price, avg(qty) AS qty, avg(top) AS top FROM per_order GROUP BY n_lines)"""


@query("scale_curve_join", f"WITH {CURVES_SQL} SELECT n_lines, round(price, 4) AS price, round(qty, 4) AS qty, round(top, 4) AS top FROM curves")
def scale_curve_join(spark, sf):
    return rounded(R.join_curves(curves(spark, sf), "n_lines", "cost"), ["price", "qty", "top"], 4)


@query("dominance_check", f"""WITH {CURVES_SQL} SELECT 'qty' AS curve, bool_or(qty < price) AS ever_below, count(*) FILTER (qty < price) AS points_below FROM curves
UNION ALL SELECT 'top', bool_or(top < price), count(*) FILTER (top < price) FROM curves""")
def dominance_check(spark, sf):
    return R.dominance(R.join_curves(curves(spark, sf), "n_lines", "cost"), "price", ["qty", "top"])


@query("affine_fit", f"""WITH {CURVES_SQL} SELECT 'price' AS curve, round(regr_intercept(price, n_lines), 3) AS fixed, round(regr_slope(price, n_lines), 3) AS slope FROM curves
UNION ALL SELECT 'qty', round(regr_intercept(qty, n_lines), 3), round(regr_slope(qty, n_lines), 3) FROM curves""")
def affine_fit(spark, sf):
    long = R.join_curves(curves(spark, sf), "n_lines", "cost").unpivot(["n_lines"], ["price", "qty"], "curve", "cost")
    return rounded(R.affine_fit(long, ["curve"], "n_lines", "cost"), ["fixed", "slope"], 3)


@query("median_latency", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_latency(spark, sf):
    return rounded(R.median_by(table(spark, sf, "events"), ["event_type"], "value"), ["median"], 6)


@query("interval_labels", """SELECT l_returnflag, printf('%+.4f [%+.4f, %+.4f]', avg(l_discount) - 0.05, min(l_discount) - 0.05, max(l_discount) - 0.05) AS label
FROM lineitem GROUP BY l_returnflag""")
def interval_labels(spark, sf):
    d = F.col("l_discount") - 0.05
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg(d).alias("m"), F.min(d).alias("lo"), F.max(d).alias("hi")).select(
        "l_returnflag", interval_label("m", "lo", "hi").alias("label"))


CUTS = [10.0, 25.0, 38.0]


@query("quartile_labels", """SELECT CASE WHEN l_quantity <= 10 THEN 'l_quantity <= 10.00' WHEN l_quantity <= 25 THEN '10.00 < l_quantity <= 25.00'
  WHEN l_quantity <= 38 THEN '25.00 < l_quantity <= 38.00' ELSE 'l_quantity > 38.00' END AS label, count(*) AS n FROM lineitem GROUP BY ALL""")
def quartile_labels(spark, sf):
    return table(spark, sf, "lineitem").groupBy(quartile_label("l_quantity", "l_quantity", CUTS).alias("label")).agg(F.count("*").alias("n"))


# A customer's strongest features stand for its explanation: the priorities (or months) it orders most.
WEIGHTS_SQL = """weights AS (SELECT o_custkey AS id, feature, weight, row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, feature) AS position
  FROM (SELECT o_custkey, o_orderpriority AS feature, CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY ALL))"""


def weights(spark, sf, only=None):
    from pyspark.sql import Window as W

    orders = table(spark, sf, "orders")
    rows = (orders if only is None else orders.filter(only)).groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("feature")).agg(
        F.count("*").cast("double").alias("weight"))
    # At most five priorities per customer.
    order = W.partitionBy("id").orderBy(F.desc("weight"), "feature")
    return rows.withColumn("position", F.row_number().over(order)).withColumn("seed", F.lit(0))


@query("feature_overlap", """WITH a AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
b AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS f FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT id, CAST(len(list_intersect(a.f, b.f)) AS INTEGER) AS common, CAST(len(a.f) AS INTEGER) AS n_a, CAST(len(b.f) AS INTEGER) AS n_b FROM a JOIN b USING (id)""")
def feature_overlap(spark, sf):
    return E.feature_overlap(weights(spark, sf, F.col("o_orderstatus") == "F"), weights(spark, sf, F.col("o_orderstatus") == "O"))


@query("appearance_counts", f"WITH {WEIGHTS_SQL} SELECT feature, count(*) AS times FROM weights WHERE position <= 2 GROUP BY feature")
def appearance_counts(spark, sf):
    return E.appearance_counts(weights(spark, sf), top=2)


@query("mean_absolute_weight", f"WITH {WEIGHTS_SQL} SELECT feature, round(sum(abs(weight)) / (SELECT count(DISTINCT id) FROM weights), 9) AS mean_abs_weight "
       "FROM weights GROUP BY feature")
def mean_absolute_weight(spark, sf):
    return rounded(E.mean_absolute_weight(weights(spark, sf)), ["mean_abs_weight"])
