import pytest
from pyspark.sql import functions as F

from rankfold import schema as S
from rankfold.operators import features as X
from rankfold.operators import profile as P
from rankfold.sources import files

PLAIN = {"id": "1", "loan_status": "Fully Paid", "issue_d": "Aug-2015", "term": " 36 months", "emp_length": "10+ years",
         "earliest_cr_line": "Aug-2003", **{c: "1" for c in S.NUMERIC_RAW}, "purpose": "car", "home_ownership": "RENT",
         "addr_state": "CA", "verification_status": "Verified"}


def frame(spark, *changes):
    rows = [{**PLAIN, "id": str(i), **c} for i, c in enumerate(changes)]
    return X.model_frame(spark.createDataFrame([tuple(r[c] for c in S.RAW_COLUMNS) for r in rows], S.text_schema(S.RAW_COLUMNS)))


def one(spark, **change):
    return frame(spark, change).first()


def test_plain_and_default_rows(spark):
    row = one(spark)
    assert (row["default"], row["issue_year"], row["credit_history_years"], row["term_months"], row["emp_length"]) == (0, 2015, 12.0, 36.0, 10.0)
    row = one(spark, loan_status="Charged Off", issue_d="Dec-2014", earliest_cr_line="Jan-2000", term=" 60 months", emp_length="< 1 year")
    assert row["default"] == 1 and row["credit_history_years"] == pytest.approx(14 + 11 / 12)
    assert (row["term_months"], row["emp_length"]) == (60.0, 0.0)


def test_unresolved_and_footer_rows_vanish(spark):
    empty = {c: None for c in S.RAW_COLUMNS}
    assert frame(spark, {"loan_status": "Current"}, {**empty, "id": "Total amount funded in policy code 1: 1"}).count() == 0


def test_malformed_text_is_null(spark):
    row = one(spark, dti="n/a", earliest_cr_line="Xxx-2001", emp_length="n/a", revol_util="")
    assert row["dti"] is None and row["credit_history_years"] is None and row["emp_length"] is None and row["revol_util"] is None
    assert one(spark, emp_length="3 years")["emp_length"] == 3.0
    assert one(spark, emp_length=None)["emp_length"] is None


def test_sentinel_and_unknown_level(spark):
    df = X.fill_sentinel(frame(spark, {"dti": "-1"}, {"dti": "n/a", "purpose": None}), S.NUMERIC)
    rows = df.orderBy("id").collect()
    assert [r["dti"] for r in rows] == [-1.0, -1.0] and rows[1]["purpose"] == S.UNKNOWN_LEVEL


def test_rare_boundary_and_unseen_levels(spark):
    train = spark.range(1000).select(F.when(F.col("id") < 9, "nine").when(F.col("id") < 19, "ten").otherwise("many").alias("level"))
    kept = X.kept_levels(train, ["level"])
    assert {r["level"] for r in kept.collect()} == {"ten", "many"}
    assert [tuple(r) for r in X.rare_levels(train, ["level"]).collect()] == [("level", "nine")]
    test = spark.createDataFrame([("ten",), ("nine",), ("new",), (None,)], "level string")
    assert [r[0] for r in X.fold_rare(test, kept, ["level"]).collect()] == ["ten", S.RARE_LEVEL, S.RARE_LEVEL, S.RARE_LEVEL]


def test_quoted_text_does_not_shift_columns(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text('id,title,loan_status\n1,"a ""quoted"" title, with comma",Fully Paid\n2,plain,Charged Off\n')
    for table in (files.read_text_table(spark, str(path), ["id", "title", "loan_status"]), files.read_text_table_by_header(spark, str(path))):
        rows = table.orderBy("id").collect()
        assert rows[0]["title"] == 'a "quoted" title, with comma' and rows[0]["loan_status"] == "Fully Paid"


def test_pruned_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    files.write_report(spark.range(5).select(*[F.col("id").alias(f"c{i}") for i in range(30)]), path)
    plan = files.read_text_table(spark, path, [f"c{i}" for i in range(30)], ["c3", "c7"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c3:string,c7:string>" in plan


def test_one_hot_slots(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "level string, x double")
    vector = X.vector_pipeline(["x"], ["level"]).fit(rows).transform(rows).first()["features"]
    assert vector.size == 1 + 4  # three levels and one for levels not seen


def test_prepare_learns_on_training_rows_only(spark):
    from pyspark.ml.functions import vector_to_array
    from rankfold.operators.split import make_split

    df = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4 == 0).cast("int").alias("default"),
                                 F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    train, test, _, kept = X.prepare(df, make_split(df), ["x"], ["kind"])
    scaled = train.select(vector_to_array("features_sc")[0].alias("z")).agg(F.avg("z"), F.stddev_samp("z")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    assert (train.count(), test.count(), kept.count()) == (320, 80, 2)


def test_each_side_is_picked_before_it_is_transformed(spark):
    """The indexer's functions count as nondeterministic, so a filter after them had all rows transformed for either side."""
    from rankfold.operators.split import make_split

    df = spark.range(40).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4 == 0).cast("int").alias("default"),
                                F.col("id").cast("double").alias("x"), F.lit("a").alias("kind"))
    train, test, *_ = X.prepare(df, make_split(df), ["x"], ["kind"])
    for side, rows in (("train", train), ("test", test)):
        assert f"EqualTo(split,{side})" in rows._jdf.queryExecution().executedPlan().toString()
    assert train.columns == ["id", "default", "rank", "fold", "features", "features_sc"] and test.columns == ["id", "default", "rank", "features", "features_sc"]


def test_join_check_counts_repeats(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "id string")
    b = spark.createDataFrame([("2",), ("3",)], "id string")
    assert X.join_check(a, b).first().asDict() == {"n_left": 3, "n_right": 2, "n_joined": 2, "repeated_left": 1, "repeated_right": 0,
                                                   "only_right": 1, "only_left": 1}


def test_record_is_resumed_and_unfinished_one_is_not(spark, tmp_path):
    path = str(tmp_path / "record")
    made = []

    def compute():
        made.append(1)
        return spark.createDataFrame([("m", 0.5)], "model string, auc double")

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("model string, auc double")
    assert files.read_record(spark, path, schema) is None
    for _ in range(2):
        assert files.resume_record(spark, path, schema, compute).first().asDict() == {"model": "m", "auc": 0.5}
    assert len(made) == 1
    (tmp_path / "begun").mkdir()
    assert files.read_record(spark, str(tmp_path / "begun"), schema) is None


def test_log_advice_and_ordinal_code(spark):
    from rankfold.operators import association as A

    df = spark.range(1, 400).select(F.exp(F.col("id") / 60).alias("long_tail"), (F.col("id") % 2).cast("double").alias("two"), F.col("id").cast("double").alias("even"))
    advice = {r["variable"]: r["advice"] for r in P.log_advice(df, ["long_tail", "two", "even"]).collect()}
    assert advice == {"long_tail": "log", "two": "binary", "even": "no"}
    grades = spark.createDataFrame([("B",), ("A",), (None,), ("C",), ("A",)], "grade string")
    assert sorted((r["grade"] or "", r["code"]) for r in A.ordinal_code(grades, "grade", "code").collect()) == [
        ("", -1), ("A", 0), ("A", 0), ("B", 1), ("C", 2)]


def test_ordinal_code_of_many_levels(spark, monkeypatch):
    from rankfold.operators import association as A

    monkeypatch.setattr(A, "PLAIN_LIMIT", 10)
    df = spark.range(3000).select(F.format_string("k%04d", F.col("id") % 1500).alias("level"))
    codes = {r["level"]: r["code"] for r in A.ordinal_code(df, "level", "code").collect()}
    assert codes == {f"k{i:04d}": i for i in range(1500)}


def test_a_record_without_its_end_marker_is_not_finished(spark, tmp_path):
    path = str(tmp_path / "record")
    files.write_record(spark.createDataFrame([("m", 1.0)], "model string, value double"), path)
    assert files.read_record(spark, path, "model string, value double").count() == 1
    (tmp_path / "record" / "_SUCCESS").unlink()
    assert files.read_record(spark, path, "model string, value double") is None


def test_kept_moments_merge_and_notice_changes(spark, tmp_path):
    from rankfold.operators import profile as P

    rows = [(float(i % 17), None if i % 5 == 0 else float(i * i), 1) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c int").cache()
    for name, part in (("first", df.filter("a < 6")), ("second", df.filter("a >= 6")), ("none", df.limit(0))):
        P.keep_moments(part, ["a", "b", "c"], str(tmp_path), name)
    P.keep_moments(df.filter("a < 6"), ["a", "b", "c"], str(tmp_path), "first")  # loaded again
    kept = P.kept_moments(spark, str(tmp_path)).cache()
    whole = {r["variable"]: r for r in P.column_moments(df, ["a", "b", "c"]).collect()}
    for r in kept.collect():
        want = whole[r["variable"]]
        assert (r["n"], r["nulls"], r["least"], r["most"]) == (want["n"], want["nulls"], want["least"], want["most"])
        assert (r["mean"], r["square"]) == (pytest.approx(want["mean"]), pytest.approx(want["square"], rel=1e-9, abs=1e-6))
    within = lambda d: {r["variable"]: r["within"] for r in P.moment_parity(d, kept, ["a", "b", "c"]).collect()}
    assert within(df) == {"a": True, "b": True, "c": True}
    changed = df.withColumns({"a": F.col("a") * 1.001, "b": F.coalesce("b", F.lit(0.0))})
    assert within(changed) == {"a": False, "b": False, "c": True}
