import pytest
from pyspark.sql import functions as F

from tabkit.operators import evaluate as E
from tabkit.operators.split import entity_role, random_role, scope, year_role


def test_random_roles_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).toDF("k")
    one = random_role(df, "k").where("role = 'test'")
    two = random_role(df.repartition(7), "k").where("role = 'test'")
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert 800 < one.count() < 1200


def test_entities_stay_on_one_side(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 300).alias("e"))
    ranked = entity_role(df, "e", "k")
    assert ranked.count() == 4000
    assert ranked.where("e is not null").groupBy("e").agg(F.count_distinct("role").alias("n")).where("n > 1").isEmpty()
    assert ranked.where("e is null").select("role").distinct().count() == 2


def test_year_holdout(spark):
    df = spark.createDataFrame([(y,) for y in (2020, 2021, 2022, 2023)], "y int")
    got = {r["y"]: r["role"] for r in year_role(df, "y", 2022).collect()}
    assert got == {2020: "train", 2021: "train", 2022: "test"}
    with pytest.raises(ValueError):
        year_role(df, "y", 2020)
    with pytest.raises(ValueError):
        year_role(df.select(F.lit(None).cast("int").alias("y")), "y")


def test_scope_uses_the_train_bound_for_both(spark):
    df = spark.createDataFrame(
        [("train", float(i)) for i in range(101)] + [("test", 98.0), ("test", 5000.0)], "role string, y double"
    )
    kept, bound, report = scope(df, "y")
    assert bound == pytest.approx(99.0)
    got = {r["role"]: (r["rows_kept"], r["rows_removed"]) for r in report.collect()}
    assert got == {"train": (100, 1), "test": (1, 1)} and kept.count() == 101


def test_grouping_sets_equal_single_reports(spark):
    df = spark.range(400).select(
        (F.col("id") % 4).cast("string").alias("a"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"),
        F.rand(1).alias("actual"),
        F.rand(2).alias("pred"),
    )
    df = df.persist()
    both = E.subgroup_reports(df, {"A": "a", "B": "b"}, min_count=1)
    for name, column in (("A", "a"), ("B", "b")):
        single = E.subgroup_errors(df, column, min_count=1).withColumn(column, F.col(column).cast("string"))
        one = {r[column]: r for r in single.collect()}
        many = {r["group_value"]: r for r in both.where(F.col("report") == name).collect()}
        assert one.keys() == many.keys()
        for key in one:
            assert all(one[key][m] == pytest.approx(many[key][m]) for m in ("n", "mae", "rmse", "r2"))
    assert None in {r["group_value"] for r in both.where("report = 'B'").collect()}
    with pytest.raises(KeyError):
        E.subgroup_errors(df, "nope")


def test_empty_bands_stay(spark):
    df = E.with_errors(spark.createDataFrame([("x", 1.0, 2.0), ("z", 4.0, 1.0), (None, 1.0, 1.0)], "b string, actual double, pred double"))
    got = [(r["b"], r["n"], r["mae"], r["median_ae"]) for r in E.band_errors(df, "b", ["x", "y", "z"]).collect()]
    assert got == [("x", 1, 1.0, 1.0), ("y", 0, None, None), ("z", 1, 3.0, 3.0)]


def test_signs_and_winners(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.5), (1.0, 1.5, 2.0), (1.0, 2.0, 0.0)], "y double, p double, q double")
    got = E.compare_two(df, "y", "p", "q", ("base", "tuned")).collect()
    assert [r["winner"] for r in got] == ["tuned", "base", "Tie"]
    row = E.with_errors(df, "y", "p").first()
    assert (row["residual"], row["error"], row["abs_error"]) == (-1.0, 1.0, 1.0)


def test_best_models_breaks_ties_by_mae(spark):
    m = spark.createDataFrame(
        [("s", "a", 2.0, 1.0, 0.1), ("s", "b", 1.5, 1.0, 0.2), ("s", "mean", 0.0, 0.0, 1.0)],
        "scenario string, model string, mae double, rmse double, r2 double",
    )
    assert E.best_models(m, ["scenario"], ["mean"]).first()["model"] == "b"
    gain = E.rmse_gain(m.where("model <> 'mean'"), "a").first()
    assert gain["gain_pct"] == 0.0
