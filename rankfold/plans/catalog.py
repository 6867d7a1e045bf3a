"""Registry of queries and the stand-in tables they share.

The star-schema tables play the loan table: an order is a loan, its status the outcome
(F bad, O good, P not yet known), its year the issue year, and rounded prices and balances
are the scores of four "models" with ties on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODELS = ["m1", "m2", "m3", "m4"]
THRESHOLDS = {"m1": 0.5, "m2": 0.45, "m3": 0.4, "m4": 0.55}


def query(name: str, sql: str | None = None):
    def register(fn):
        REGISTRY[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def number_sql(values: list[float]) -> str:
    """List of doubles; exponent notation keeps every bit in SQL."""
    return "[" + ", ".join(f"{v:.17e}" for v in values) + "]"


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved orders with their customer: `(id, y, price, acct, priority, segment, nationkey, period)`."""
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("acct"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nationkey"), F.year("o_orderdate").alias("period"))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Wide score table `(id, y, m1..m4)`."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    top = orders.agg(F.max("o_totalprice").alias("v")).scalar()
    low = customer.agg(F.min("c_acctbal").alias("v")).scalar()
    spread = customer.agg((F.max("c_acctbal") - F.min("c_acctbal")).alias("v")).scalar()
    return base(spark, sf).select(
        "id", "y", (F.floor(1000 * F.col("price") / top) / 1000).alias("m1"),
        (F.floor(100 * (F.col("acct") - low) / spread) / 100).alias("m2"),
        ((F.col("id") * 7919 % 1000).cast("double") / 1000).alias("m4"),
    ).select("id", "y", "m1", "m2", (F.floor(50 * (F.col("m1") + F.col("m2"))) / 100).alias("m3"), "m4")


def long(spark: SparkSession, sf: str) -> DataFrame:
    """Long score table `(id, y, model, score)`."""
    return wide(spark, sf).unpivot(["id", "y"], MODELS, "model", "score")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Long score table of two engines: `fine` scores as they are, `coarse` cut to one digit."""
    engines = F.explode(F.array(
        F.struct(F.lit("fine").alias("engine"), F.col("score").alias("s")),
        F.struct(F.lit("coarse").alias("engine"), (F.floor(10 * F.col("score")) / 10).alias("s"))))
    return long(spark, sf).select("id", "y", "model", engines.alias("e")).select(
        "id", "y", "model", F.col("e.engine").alias("engine"), F.col("e.s").alias("score"))


BASE_SQL = """base AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS price, c_acctbal AS acct,
         o_orderpriority AS priority, c_mktsegment AS segment, c_nationkey AS nationkey,
         CAST(year(o_orderdate) AS INTEGER) AS period
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O'))"""
WIDE_SQL = BASE_SQL + """,
wide AS (
  SELECT id, y, m1, m2, floor(50 * (m1 + m2)) / 100 AS m3, m4 FROM (
    SELECT id, y, floor(1000 * price / (SELECT max(o_totalprice) FROM orders)) / 1000 AS m1,
           floor(100 * (acct - (SELECT min(c_acctbal) FROM customer))
                 / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer)) / 100 AS m2,
           CAST(id * 7919 % 1000 AS DOUBLE) / 1000 AS m4 FROM base))"""
LONG_SQL = WIDE_SQL + """,
long AS (
  SELECT id, y, 'm1' AS model, m1 AS score FROM wide UNION ALL SELECT id, y, 'm2', m2 FROM wide
  UNION ALL SELECT id, y, 'm3', m3 FROM wide UNION ALL SELECT id, y, 'm4', m4 FROM wide)"""
VARIANTS_SQL = LONG_SQL + """,
variants AS (
  SELECT id, y, model, 'fine' AS engine, score FROM long
  UNION ALL SELECT id, y, model, 'coarse', floor(10 * score) / 10 FROM long)"""


def curve_sql(source: str, by: str, score: str = "score") -> str:
    """CTE `curve`: positives and negatives per score, below it and in total."""
    return f"""
cells AS (SELECT {by}, {score} AS score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
          FROM {source} GROUP BY ALL),
curve AS (
  SELECT *, sum(pos) OVER w - pos AS pos_below, sum(neg) OVER w - neg AS neg_below,
         sum(pos) OVER (PARTITION BY {by}) AS pos_total, sum(neg) OVER (PARTITION BY {by}) AS neg_total
  FROM cells WINDOW w AS (PARTITION BY {by} ORDER BY score))"""


AUC_SQL = "sum(pos * (neg_below + neg / 2)) / (max(pos_total) * max(neg_total))"
AP_SQL = ("sum(pos / pos_total * (pos_total - pos_below)"
          " / (pos_total - pos_below + neg_total - neg_below))")

# Tail probabilities by series, for checking p values in SQL.
LOWER_GAMMA_SQL = ("(exp({a} * ln({x}) - {x} - lgamma({a} + 1)) * (1 + list_sum(list_transform(range(1, 400), "
                   "lambda i: exp(i * ln({x}) + lgamma({a} + 1) - lgamma({a} + i + 1))))))")


def chi2_tail_sql(x: str, dof: str) -> str:
    a, half = f"(CAST({dof} AS DOUBLE) / 2)", f"(CAST({x} AS DOUBLE) / 2)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0, 1 - {LOWER_GAMMA_SQL.format(a=a, x=half)}) END"


def normal_tail_sql(z: str) -> str:
    return chi2_tail_sql(f"({z} * {z})", "1")
