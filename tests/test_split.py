import math

from pyspark.sql import functions as F

from rankfold.operators import split as S


def population(spark, n=1003):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5 == 0).cast("int").alias("default"))


def test_counts_folds_and_ranks(spark):
    df = population(spark)
    split = S.make_split(df).join(df, "id").toPandas()
    assert len(split) == 1003
    for label, part in split.groupby("default"):
        assert part["is_test"].sum() == math.ceil(0.2 * len(part) - 1e-9)
        sizes = part[~part["is_test"]]["fold"].value_counts()
        assert set(sizes.index) == {0, 1, 2} and sizes.max() - sizes.min() <= 1
    train = split[~split["is_test"]]
    assert sorted(train["rank"]) == list(range(len(train)))
    assert (split[split["is_test"]][["fold", "rank"]] == -1).all().all()
    assert (split["split"].eq("test") == split["is_test"]).all()


def test_layout_does_not_matter(spark):
    df = population(spark)
    a, b = S.make_split(df.repartition(3)), S.make_split(df.repartition(31), digits=2)
    assert S.table_difference(a, b).first().asDict() == {"missing": 0, "extra": 0}


def test_prefixes_are_nested(spark):
    split = S.make_split(population(spark))
    small = {r["id"] for r in S.prefix_subset(split, 100).collect()}
    large = {r["id"] for r in S.prefix_subset(split, 300).collect()}
    assert len(small) == 100 and len(large) == 300 and small < large


def test_sample_is_exact_and_positions_are_a_permutation(spark):
    df = population(spark)
    assert S.hash_sample(df, "id", 77).count() == 77
    assert S.hash_sample(df, "id", 5000).count() == 1003
    positions = [r["position"] for r in S.hash_positions(df, "id", 9).collect()]
    assert sorted(positions) == list(range(1003))
    head = {r["id"] for r in S.hash_positions(df, "id", 9).filter("position < 77").collect()}
    assert head == {r["id"] for r in S.hash_sample(df, "id", 77, seed=9).collect()}


def test_differences_are_reported(spark):
    split = S.make_split(population(spark))
    assert S.table_difference(split, split.filter("rank <> 5")).first().asDict() == {"missing": 1, "extra": 0}
    overlap = S.id_overlap(split.filter("is_test"), split.filter("rank < 10")).first()
    assert overlap["n_common"] == overlap["n_a"] == 202


def test_whole_fraction_keeps_every_row(spark):
    # The hash of one id in 4.3e9 starts with eight f; with a whole fraction no hash is looked at.
    df = spark.range(50).select(F.col("id").cast("string").alias("id"))
    plan = S.fraction_sample(df, "id", 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan.lower() and S.fraction_sample(df, "id", 1.0).count() == 50
    assert 0 < S.fraction_sample(df, "id", 0.5).count() < 50
