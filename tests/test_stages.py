import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabkit.operators import stages as S
from tabkit.session import attach, scratch_path, settle


def pairs(df, a, b):
    return {r[a]: r[b] for r in df.collect()}


def reload(spark, model):
    path = scratch_path(spark, "stage")
    model.write().save(path)
    return type(model).load(path)


def test_group_median_uses_global_for_missing_group(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, 5.0), (3, "a", 3.0), (4, None, None), (5, "b", None), (6, "a", None), (7, "new", None)],
        "i int, g string, v double",
    )
    model = S.GroupMedianFill(inputCols=["v"], groupCol="g").fit(df.where("i < 7"))
    for m in (model, reload(spark, model)):
        assert pairs(m.transform(df), "i", "v") == {1: 1.0, 2: 5.0, 3: 3.0, 4: 3.0, 5: 3.0, 6: 2.0, 7: 3.0}


def test_median_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None)], "i int, e double, v double")
    got = S.MedianFill(inputCols=["e", "v"]).fit(df).transform(df)
    assert pairs(got, "i", "e") == {1: 0.0, 2: 0.0} and pairs(got, "i", "v") == {1: 1.0, 2: 1.0}


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "i int, c string")
    assert pairs(S.ModeFill(inputCols=["c"]).fit(df).transform(df), "i", "c")[5] == "a"


@pytest.mark.parametrize("small", [True, False])
def test_rare_groups(spark, small):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)] * 9, "c string")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zzz"), (4, None)], "i int, c string")
    model = S.RareGrouper(inputCols=["c"], outputCols=["d"], minCount=3).fit(train)
    model.small = small
    assert pairs(model.transform(test), "i", "d") == {1: "a", 2: "Other", 3: "Other", 4: "Missing"}
    assert model.transform(test).columns == ["i", "c", "d"]


@pytest.mark.parametrize("small", [True, False])
def test_category_mean(spark, small):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0), (None, 4.0)], "c string, y double")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, "new"), (4, None)], "i int, c string")
    model = S.CategoryMeanRegressor(categoryCol="c", labelCol="y").fit(train)
    model.small = small
    assert pairs(model.transform(test), "i", "prediction") == {1: 2.0, 2: 8.0, 3: 4.0, 4: 4.0}
    middle = S.CategoryMeanRegressor(categoryCol="c", labelCol="y", fallback="median").fit(train)
    assert pairs(middle.transform(test), "i", "prediction")[3] == 3.5
    with pytest.raises(KeyError):
        S.CategoryMeanRegressor(categoryCol="nope", labelCol="y").fit(train)


def test_population_scaling_and_back(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    model = S.PopulationScaler(inputCols=["x", "k"], outputCols=["a", "b"]).fit(df)
    got = model.transform(df)
    assert sorted(r["a"] for r in got.collect()) == [-1.0, 1.0]
    assert {r["b"] for r in got.collect()} == {0.0}
    assert sorted(r["a"] for r in model.inverse(got).collect()) == [1.0, 3.0]


def test_winsorizer_bounds_come_from_training(spark):
    train = spark.range(101).select(F.col("id").cast("double").alias("x"))
    model = S.Winsorizer(inputCols=["x"], outputCols=["w"]).fit(train)
    test = spark.createDataFrame([(-5.0,), (50.0,), (1000.0,), (None,)], "x double")
    for m in (model, reload(spark, model)):
        assert [r["w"] for r in m.transform(test).collect()] == [1.0, 50.0, 99.0, None]


def test_pipeline_with_table_models_round_trip(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "c string, y double")
    fitted = Pipeline(
        stages=[S.RareGrouper(inputCols=["c"], minCount=2), S.CategoryMeanRegressor(categoryCol="c", labelCol="y")]
    ).fit(df)
    path = scratch_path(spark, "pipe")
    fitted.write().overwrite().save(path)
    again = PipelineModel.load(path)
    key = lambda m: sorted((r["c"], r["prediction"]) for r in m.transform(df).collect())
    assert key(again) == key(fitted) == [("Other", 8.0), ("a", 2.0), ("a", 2.0)]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [0, 100])
def test_attach_routes_agree(spark, how, limit):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    table = rows.where("k <> 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    table = table.where("k <> 'k8'")
    found = attach(rows, table, ["k"], how, max_rows=limit, weight="n")
    expected = rows.join(table, "k", how)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    assert found.count() == expected.count()


@pytest.mark.parametrize("weight", ["n", None])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_large_join_with_mostly_missing_keys(spark, how, weight):
    key = F.when(F.col("id") % 10 == 0, F.col("id") % 70)
    rows = spark.range(5000).select(key.alias("k"), "id")
    table = rows.where("k > 10").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found, expected = attach(rows, table, ["k"], how, max_rows=0, weight=weight), rows.join(table, "k", how)
    assert found.columns == expected.columns and found.count() == expected.count()
    assert found.exceptAll(expected).isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert how == "inner" or "Union" in plan


def test_settle_computes_large_tables_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    table, small = settle(spark.range(0, 50, 1, 4).mapInArrow(count, "id long"), 10)
    assert small is False and table.count() == 50 and seen.value == 50
    wide = spark.range(4).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert settle(wide, 10, max_bytes=3000)[1] is False and settle(wide, 10)[1] is True


def test_settle_reports_size(spark):
    assert settle(spark.range(5).toDF("a"), 5)[1] is True
    table, small = settle(spark.range(6).toDF("a"), 5)
    assert small is False and table.count() == 6
