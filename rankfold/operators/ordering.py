"""Ordered statistics without a single-task sort.

Ranks, quantiles, ROC curves and their kin all need, for each distinct value of a
group, how much lies below it. A window over the whole group would sort it in one
task, so the work is done in these steps:

1. rows collapse to one row per (group, value) with partial aggregation, which removes
   ties before anything is shuffled - a value held by a third of all rows becomes one row;
2. when many distinct values remain, Spark deals them into ranges of about `RANGE_ROWS`, as many as
   the values need; the numbered ranges are stored, and each (group, range) is summed in its own task;
3. the range totals are summed in order - by the same steps, if there are too many of them for
   one task - and joined back on (group, range).

The stored range numbers don't move when tasks are rerun. Ranges decide balance only, never results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankfold.operators.selection import MOST, select_quantiles
from rankfold.session import materialize

#: Distinct values up to which one window task per group is used.
PLAIN_LIMIT = 500_000
#: Distinct values aimed at for one range of a larger table.
RANGE_ROWS = 250_000
#: Rows of a value table that may be broadcast to the row side of a lookup.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Distribution:
    """One row per (keys, value): sums, `<sum>_below`, and `<sum>_total` of the group."""

    table: DataFrame
    keys: tuple[str, ...]
    value: str
    sums: tuple[str, ...]
    distinct: int


def count_distinct_pairs(df: DataFrame, columns: list[str]) -> int:
    """Approximate number of distinct combinations, from one pass without a row shuffle."""
    return df.agg(F.approx_count_distinct(F.xxhash64(*columns)).alias("n")).first()["n"]


def distribution(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, Column],
    distinct: int | None = None,
    plain_limit: int = PLAIN_LIMIT,
    range_rows: int = RANGE_ROWS,
) -> Distribution:
    """Running sums of `sums` over the ascending distinct values of each group.

    Null values do not take part. Values keep their own type, so integers and decimals beyond 2^53
    stay apart. Unless `distinct` is given, one small job on `df` counts
    the distinct values; materialise `df` first when it is costly.
    """
    source = df.filter(F.col(value).isNotNull())
    if distinct is None:
        distinct = count_distinct_pairs(source, [*keys, value])
    counts = source.groupBy(*keys, value).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    names = list(sums)
    table = running_sums(counts, keys, value, names, distinct, plain_limit, range_rows)
    return Distribution(table, tuple(keys), value, tuple(names), distinct)


def running_sums(table: DataFrame, keys: list[str], value: str, names: list[str], rows: int, plain_limit: int = PLAIN_LIMIT,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """`<name>_below` and `<name>_total` of each group for a table of about `rows` distinct (keys, value), of any type that sorts."""
    if rows <= max(plain_limit, 2):  # two ranges are no fewer than two rows
        return _plain(table, keys, value, names)
    return _ranged(table, keys, value, names, -(-rows // range_rows), plain_limit, range_rows)


def _plain(counts: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    whole = W.partitionBy(*keys)
    below = whole.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        "*",
        *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"{n}_below") for n in names],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
    )


def _ranged(table: DataFrame, keys: list[str], value: str, names: list[str], ranges: int, plain_limit: int, range_rows: int) -> DataFrame:
    at = f"_range_of_{value}"
    placed = table.repartitionByRange(max(2, ranges), *[F.col(k) for k in keys], F.col(value))
    placed = materialize(placed.withColumn(at, F.spark_partition_id()))
    within = W.partitionBy(*keys, at).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    rows = placed.select("*", *[F.coalesce(F.sum(n).over(within), F.lit(0)).alias(f"_in_{n}") for n in names])
    # A group's ranges are again rows in order; only very many of them are cut to ranges themselves.
    totals = placed.groupBy(*keys, at).agg(*[F.sum(n).alias(n) for n in names])
    offsets = running_sums(totals, keys, at, names, max(2, ranges), plain_limit, range_rows)
    offsets = offsets.select(*keys, at, *[F.col(f"{n}_below").alias(f"_off_{n}") for n in names], *[f"{n}_total" for n in names])
    return join_on_keys(rows, offsets, [*keys, at]).select(
        *keys, value, *[c for c in table.columns if c not in (*keys, value)],
        *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(f"{n}_below") for n in names],
        *[f"{n}_total" for n in names],
    )


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns, or plain side-by-side when `right` is one global row."""
    if keys:
        return left.join(right, keys, how)
    return left.withColumn("_k", F.lit(1)).join(F.broadcast(right.withColumn("_k", F.lit(1))), "_k", how).drop("_k")


def with_group_columns(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-group columns where the groups are columns, models or classes.

    The number of such groups is fixed by the schema or the model list, not by the
    rows, which is what makes the broadcast safe.
    """
    if not keys:
        return join_on_keys(df, totals, [])
    return df.join(F.broadcast(totals), keys)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float],
                    found: Distribution | None = None) -> DataFrame:
    """Linear-interpolation quantiles, one row per (keys, probability) as `(keys, prob, quantile)`.

    `found` may be a distribution of the same rows with a count named `n`. Without one a few quantiles are selected
    from brackets; `distribution` answers where many are asked for.
    """
    if found is None and len(probabilities) <= MOST:
        selected = select_quantiles(df, keys, value, probabilities)
        if selected is not None:
            return selected
    if found is None:
        found = distribution(df, keys, value, {"n": F.lit(1)})
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    # Each value answers for the 0-based positions n_below .. n_below + n - 1; a quantile lies
    # between two neighbouring positions, so at most two values answer for it.
    last = F.col("n_total").cast("double") - 1

    def mine(p: Column) -> Column:
        first_at, last_at = F.col("n_below"), F.col("n_below") + F.col("n") - 1
        return F.floor(p * last).between(first_at, last_at) | F.ceil(p * last).between(first_at, last_at)

    hit = (found.table.withColumn("prob", F.explode(F.filter(probs, mine)))
           .withColumn("_pos", F.col("prob") * last).withColumn("_lo", F.floor("_pos")))
    low, high = F.min(value), F.max(value)
    weight = F.first(F.col("_pos") - F.col("_lo"))
    return hit.groupBy(*keys, "prob").agg((low.cast("double") + (high - low).cast("double") * weight).alias("quantile"))


def lookup(rows: DataFrame, found: Distribution, on: dict[str, str], take: list[str],
           weight: str = "n", broadcast_rows: int = BROADCAST_ROWS, hot_share: float = 0.001) -> DataFrame:
    """Bring columns of a value table to the rows holding those values.

    `on` maps row columns to table columns. Small tables (by measured size) are broadcast.
    For larger ones, the values that hold more than `hot_share` of a group's rows - at most
    1/hot_share per group - are broadcast and only the remaining rows are shuffled, so a
    value shared by a third of all rows never gathers in one task. Rows pass both joins in one
    branch: a settled row has no value left to look for and is dealt by a hash of itself.
    """
    table = found.table.select(*[F.col(t).alias(f"_t_{r}") for r, t in on.items()],
                               *[F.col(c).alias(f"_v_{c}") for c in take],
                               (F.col(weight) > F.col(f"{weight}_total") * hot_share).alias("_hot"))
    condition = [F.col(r) == F.col(f"_t_{r}") for r in on]
    drop = [f"_t_{r}" for r in on]
    if found.distinct <= broadcast_rows:
        joined = rows.join(F.broadcast(table.drop("_hot")), _all(condition))
        return joined.select(*rows.columns, *[F.col(f"_v_{c}").alias(c) for c in take])
    hot = table.filter("_hot").select(*drop, F.struct(*[f"_v_{c}" for c in take]).alias("_first"))
    rest = table.filter(~F.col("_hot")).select(
        *[F.col(c).alias(f"_s{c}") for c in drop], F.struct(*[f"_v_{c}" for c in take]).alias("_second"), F.lit(0).alias("_deal"))
    settled = F.col("_first").isNotNull()
    dealt = rows.join(F.broadcast(hot), _all(condition), "left").drop(*drop).withColumns({
        "_part": F.when(settled, F.pmod(F.xxhash64(*rows.columns), F.lit(4095)).cast("int") + 1).otherwise(F.lit(0)),
        **{f"_k_{r}": F.when(~settled, F.col(r)) for r in on}})
    match = [F.col(f"_k_{r}") == F.col(f"_s_t_{r}") for r in on] + [F.col("_part") == F.col("_deal")]
    joined = dealt.join(rest, _all(match), "left").withColumn("_found", F.coalesce("_first", "_second"))
    return joined.filter("_found is not null").select(*rows.columns, *[F.col(f"_found._v_{c}").alias(c) for c in take])


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def midranks_of(df: DataFrame, id_column: str, columns: list[str], keep: tuple[str, ...] = (), suffix: str = "_rank", percent: str = "_pct") -> DataFrame:
    """`(id, *keep, <column>, <column><suffix>, <column><percent>)` of several score columns at once; ids are unique.

    The columns are one long table with one distribution and one lookup, put side by side again by id, so
    neither scans nor shuffles grow with their number. A null score has null ranks.
    """
    long = df.select(id_column, *keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([id_column, *keep], columns, "_column", "_score")
    ranked = midranks(long, ["_column"], "_score", "_rank", "_pct")
    side = ranked.groupBy(id_column, *keep).pivot("_column", columns).agg(F.first("_score").alias("v"), F.first("_rank").alias("r"), F.first("_pct").alias("p"))
    return side.select(id_column, *keep, *[x for c in columns for x in (
        F.col(f"{c}_v").alias(c), F.col(f"{c}_r").alias(f"{c}{suffix}"), F.col(f"{c}_p").alias(f"{c}{percent}"))])


def midranks(df: DataFrame, keys: list[str], value: str, name: str = "midrank",
             percent: str | None = None) -> DataFrame:
    """Average rank of ties within each group; `percent` adds midrank / n."""
    found = distribution(df, keys, value, {"n": F.lit(1)})
    table = found.table.withColumn(name, F.col("n_below") + (F.col("n") + 1) / 2.0)
    take = [name]
    if percent:
        table = table.withColumn(percent, F.col(name) / F.col("n_total"))
        take.append(percent)
    ranked = Distribution(table, found.keys, found.value, found.sums, found.distinct)
    return lookup(df.filter(F.col(value).isNotNull()), ranked, {**{k: k for k in keys}, value: value}, take)
