import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from rankfold.operators import ordering as O
from rankfold.operators.selection import select_quantiles


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[: len(keys) or None])


@pytest.mark.parametrize("column", ["a", "b", "c"])
def test_ranged_form_equals_plain_form(scores, column):
    df, _ = scores
    sums = {"pos": F.col("y").cast("long"), "n": F.lit(1)}
    plain = O.distribution(df, [], column, sums).table
    ranged = O.distribution(df, [], column, sums, plain_limit=0, range_rows=50).table
    assert rows(plain.select(*sorted(plain.columns))) == rows(ranged.select(*sorted(plain.columns)))


def test_ranged_form_with_groups_spreads_every_group(scores):
    df, _ = scores
    long = df.unpivot(["id", "y"], ["a", "b", "c"], "model", "score")
    sums = {"pos": F.col("y").cast("long"), "neg": (1 - F.col("y")).cast("long")}
    plain = O.distribution(long, ["model"], "score", sums).table
    ranged = O.distribution(long, ["model"], "score", sums, plain_limit=0, range_rows=100).table
    columns = sorted(plain.columns)
    assert rows(plain.select(*columns)) == rows(ranged.select(*columns))


@pytest.mark.parametrize("column", ["b", "id"])
def test_ranges_of_ranges_equal_plain_form(scores, column):
    """300 ranges, whose totals are cut to ranges again, and those once more; for numbers and for texts."""
    df, _ = scores
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    plain = O.running_sums(counts, [], column, ["n"], 3000)
    cut = O.running_sums(counts, [], column, ["n"], 3000, plain_limit=3, range_rows=10)
    columns = sorted(plain.columns)
    assert rows(plain.select(*columns)) == rows(cut.select(*columns))


def test_ordinal_codes_of_many_levels(spark):
    from rankfold.operators.association import ordinal_code

    df = spark.createDataFrame([(f"l{i % 700:04d}",) for i in range(2100)] + [(None,)], "level string").repartition(5)
    for limits in ({}, {"plain_limit": 4, "range_rows": 30}):
        got = {(r["level"], r["code"]) for r in ordinal_code(df, "level", "code", **limits).collect()}
        assert got == {(f"l{i:04d}", i) for i in range(700)} | {(None, -1)}


@pytest.mark.parametrize("grid, accuracy, bracket_rows", [(64, 2000, 10**6), (8, 50, 40), (4, 20, 1)])
def test_selected_quantiles_equal_ordered_ones(scores, grid, accuracy, bracket_rows):
    df, frame = scores
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.975, 1.0]
    long = df.unpivot(["id"], ["a", "b", "c"], "model", "score")
    found = select_quantiles(long, ["model"], "score", probabilities, grid, accuracy, bracket_rows)
    got = {(r["model"], r["prob"]): r["quantile"] for r in found.collect()}
    for m in ("a", "b", "c"):
        assert [got[m, p] for p in probabilities] == pytest.approx(list(np.quantile(frame[m], probabilities)), abs=1e-12)
    alone = {r["prob"]: r["quantile"] for r in select_quantiles(df, [], "b", [0.5, 0.5], grid, accuracy, bracket_rows).collect()}
    assert alone == {0.5: pytest.approx(float(np.quantile(frame["b"], 0.5)), abs=1e-12)}


def test_selection_of_few_and_missing_values(spark):
    df = spark.createDataFrame([("p", 1), ("p", None), ("q", None), ("r", 5), ("r", 7)], "g string, v long")
    assert {(r["g"], r["quantile"]) for r in O.exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {("p", 1.0), ("r", 6.0)}
    assert O.exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_selection_orders_few_values(scores):
    """Only values inside brackets are shuffled by value: the plan has no second exchange of all of them."""
    df, _ = scores
    cells = []
    original = DataFrame.groupBy

    def watched(self, *keys):
        if "v" in [str(k).split(".")[-1] for k in keys]:
            cells.append(self.filter("e.v is not null").count())
        return original(self, *keys)

    DataFrame.groupBy, kept = watched, original
    try:
        select_quantiles(df, [], "b", [0.5]).collect()
    finally:
        DataFrame.groupBy = kept
    assert len(cells) == 1 and cells[0] < 3000 * 3 / 64


def test_quantiles_interpolate_linearly(scores):
    df, frame = scores
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.975, 1.0]
    for limit in (0, O.PLAIN_LIMIT):
        found = O.distribution(df, [], "b", {"n": F.lit(1)}, plain_limit=limit, range_rows=100)
        got = {r["prob"]: r["quantile"] for r in O.exact_quantiles(df, [], "b", probabilities, found).collect()}
        assert [got[p] for p in probabilities] == pytest.approx(list(np.quantile(frame["b"], probabilities)), abs=1e-12)


def test_midranks_average_ties(scores):
    df, frame = scores
    want = frame["a"].rank()
    got = {r["id"]: (r["midrank"], r["pct"]) for r in O.midranks(df, [], "a", percent="pct").collect()}
    assert [got[i][0] for i in frame["id"]] == list(want)
    assert [got[i][1] for i in frame["id"]] == pytest.approx(list(frame["a"].rank(pct=True)), abs=1e-12)


@pytest.mark.parametrize("column", ["a", "b"])
def test_lookup_without_broadcast_handles_hot_values(scores, column):
    df, frame = scores
    found = O.distribution(df, [], column, {"n": F.lit(1)})
    out = O.lookup(df.select("id", column), found, {column: column}, ["n_below"], broadcast_rows=0, hot_share=0.05)
    got = {r["id"]: r["n_below"] for r in out.collect()}
    assert len(got) == len(frame)
    assert [got[i] for i in frame["id"]] == list(frame[column].rank(method="min").astype(int) - 1)


def test_nulls_take_no_part(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (2.0,)], "v double")
    table = O.distribution(df, [], "v", {"n": F.lit(1)}).table
    assert rows(table.select("v", "n", "n_below", "n_total")) == [(1.0, 1, 0, 3), (2.0, 2, 1, 3)]


def test_neighbours_beyond_double_precision_stay_apart(spark):
    from decimal import Decimal

    longs = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 1,)], "v long")
    assert sorted((r["v"] - 2**53, r["midrank"]) for r in O.midranks(longs, [], "v").collect()) == [(0, 1.0), (1, 2.5), (1, 2.5)]
    exact = spark.createDataFrame([(Decimal("90071992547409.93"),), (Decimal("90071992547409.92"),)], "v decimal(20,2)")
    for limit in (0, 10):
        found = O.distribution(exact, [], "v", {"n": F.lit(1)}, plain_limit=limit)
        assert found.table.count() == 2


def test_ranks_of_several_columns_at_once(scores):
    df, frame = scores
    got = {r["id"]: r for r in O.midranks_of(df, "id", ["a", "b", "c"], ("y",)).collect()}
    assert len(got) == len(frame)
    for c in ("a", "b", "c"):
        assert [got[i][f"{c}_rank"] for i in frame["id"]] == list(frame[c].rank())
        assert [got[i][f"{c}_pct"] for i in frame["id"]] == pytest.approx(list(frame[c].rank(pct=True)), abs=1e-12)
    assert [got[i]["y"] for i in frame["id"]] == list(frame["y"])


def test_ranks_scan_and_shuffle_once_whatever_the_number_of_columns(scores):
    df, _ = scores
    shuffles = []
    for columns in (["a"], ["a", "b"], ["a", "b", "c"]):
        shuffles.append(O.midranks_of(df, "id", columns)._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert len(set(shuffles)) == 1
