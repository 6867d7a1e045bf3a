"""Mixing sources to target weights by repeating documents.

Words are summed per source, each source gets a target by weight, no source may exceed `cap` times its own words, and
what a capped source leaves is shared out again by weight. A document is taken floor(rate) times, and once more if a
uniform number hashed from seed and id falls below the fraction, so reruns and retried tasks agree.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; a source without words has
target 0 and is not taken; rows that share an id share the hashed number; extra columns are carried through `emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankfold.llm.common import materialize, unit_hash, unit_hash_sql

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`(source, source_size, target)`; `sizes` holds `(source, size)` per document.

    Sources are ordered by code point, null last, and take the weights in turn. The water level rises until the targets
    share out `share` times all words: each round caps the sources that the level has passed, until none is added. A
    round reads one small row of sums, however many sources there are.
    """
    if share > cap:
        raise ValueError("the targets can't exceed cap times all words")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = materialize(_numbered(totals).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))))
    everything = totals.agg(F.sum("source_size")).first()[0] or 0
    level, capped, most = 0.0, -1, F.lit(float(cap)) * F.col("source_size")
    while True:
        full = F.col("weight") * F.lit(level) >= most
        row = totals.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("held"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        level = (share * everything - cap * row["held"]) / row["open"]
    return totals.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def _numbered(totals: DataFrame) -> DataFrame:
    """`at`: position of each source in code-point order, null last, without one task that sorts all sources.

    Sources are cut to ranges by their first characters; only the counts of these ranges are ordered in one place.
    """
    lead = F.coalesce(F.substring("source", 1, 2), F.lit(""))
    last = F.col("source").isNull()
    totals = totals.withColumns({"last": last, "lead": lead})
    counts = totals.groupBy("last", "lead").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(
        Window.orderBy("last", "lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("last", "lead").orderBy("source"))
    return totals.withColumn("inside", inside).join(before.drop("n"), ["last", "lead"]).select(
        "source", "source_size", (F.col("before") + F.col("inside") - 1).alias("at"))


def copies(docs: DataFrame, targets: DataFrame, id_column: str, seed: str = SEED) -> DataFrame:
    """Adds `(source_size, target, copies)` to rows with `source`; the few sources are joined by measured size."""
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.col("target") / F.col("source_size")
    whole = F.floor(rate)
    taken = whole + (unit_hash(seed, id_column) < rate - whole).cast("long")
    return docs.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn(
        "copies", F.when(F.col("source_size") > 0, taken).otherwise(F.lit(0)).cast("long"))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights=(3, 1, 2),
        share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """`(id, size, source_size, target, taken)` of every row. Texts are read once; only ids, sources and sizes are kept."""
    sizes = materialize(docs.select(F.col(id_column), F.col(source_column).alias("source"), word_count(text_column).alias("size")))
    return copies(sizes, source_targets(sizes, weights, share, cap), id_column, seed).select(
        F.col(id_column), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights=(3, 1, 2),
         share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns."""
    sizes = docs.select(F.col(source_column).alias("source"), word_count(text_column).alias("size"))
    targets = source_targets(sizes, weights, share, cap)
    narrow = docs.withColumns({"_row": F.struct(*[F.col(c) for c in docs.columns])}).select(
        F.col(id_column), F.col(source_column).alias("source"), "_row")
    taken = copies(narrow, targets, id_column, seed).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM totals),
-- Sources in the order in which the rising level reaches their cap; the level lies where the rest still fits.
ranked AS (
  SELECT *, coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighted WINDOW w AS (ORDER BY 2.0 * source_size / weight, source)),
level AS (
  SELECT min_by((1.5 * (SELECT sum(source_size) FROM totals) - 2.0 * held) / open, 2.0 * source_size / weight) AS level FROM ranked
  WHERE (1.5 * (SELECT sum(source_size) FROM totals) - 2.0 * held) / open <= 2.0 * source_size / weight),
targets AS (SELECT source, source_size, least(weight * (SELECT level FROM level), 2.0 * source_size) AS target FROM weighted),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN @u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
""".replace("@u", unit_hash_sql(SEED, "doc_id"))
