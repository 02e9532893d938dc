"""One-hot vectors from a dictionary table, against Spark's own indexer and at a size beyond broadcasts."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tabkit.operators import stages
from tabkit.operators.coding import CategoryCoder
from tabkit.session import scratch_path, settle

TRAIN = [("b", "x", 1), ("a", "x", 2), ("b", None, 3), ("é\"\\", "y", 4), (None, "w", 5), ("Z", "x", 6), ("🦊", "y", 7)]
TEST = [("a", "y", 1), ("new", "x", 2), (None, None, 3), ("é\"\\", "w", 4), ("🦊", "z", 5), ("Z", "y", 6)]
SCHEMA = "k string, `odd.name` string, place int"


def test_equal_to_the_indexer(spark):
    train, test = spark.createDataFrame(TRAIN, SCHEMA), spark.createDataFrame(TEST, SCHEMA)
    plain = ["k", "o"]
    want = Pipeline(stages=[
        StringIndexer(inputCols=plain, outputCols=["i", "j"], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["i", "j"], outputCols=["p", "q"], dropLast=True),
        VectorAssembler(inputCols=["p", "q"], outputCol="all"),
    ]).fit(train.withColumnRenamed("odd.name", "o")).transform(test.withColumnRenamed("odd.name", "o"))
    pipe = Pipeline(stages=[
        CategoryCoder(inputCols=["k", "odd.name"], outputCols=["p", "q"]),
        VectorAssembler(inputCols=["p", "q"], outputCol="all"),
    ]).fit(train)
    path = scratch_path(spark, "coder")
    pipe.write().save(path)
    order = lambda df: [tuple(r) for r in df.select("place", "p", "q", "all").orderBy("place").collect()]
    for model in (pipe, PipelineModel.load(path)):
        got = model.transform(test)
        assert order(got) == order(want)
        assert got.schema["all"].metadata["ml_attr"]["num_attrs"] == 8
        names = [a["name"] for g in got.schema["all"].metadata["ml_attr"]["attrs"].values() for a in g]
        assert names[:2] == ["p_Z", "p_a"] and names[-1] == "q_y"
    assert not [n for n in pipe.transform(test).columns if n.startswith("__")]


def test_empty_tables_and_columns_without_labels(spark):
    train = spark.createDataFrame([(None, "x", 1)], SCHEMA)
    coder = CategoryCoder(inputCols=["k", "odd.name"], outputCols=["p", "q"]).fit(train)
    got = coder.transform(spark.createDataFrame(TEST, SCHEMA)).orderBy("place").collect()
    assert [r["p"].size for r in got] == [0] * 6 and [r["q"].toArray().tolist() for r in got][:3] == [[0], [1], [0]]
    assert coder.transform(train.limit(0)).count() == 0
    blank = CategoryCoder(inputCols=["k"], outputCols=["p"]).fit(train.fillna(""))
    wide = VectorAssembler(inputCols=["p"], outputCol="all").transform(blank.transform(train.fillna("")))
    assert wide.first()["all"].toArray().tolist() == [1.0]
    assert CategoryCoder(inputCols=["k"], outputCols=["p"]).fit(train.limit(0)).transform(train).first()["p"].size == 0


@pytest.mark.parametrize("labels", [1000, 1_000_000])
def test_dictionaries_of_any_size(spark, monkeypatch, labels):
    """Beyond the limit of a broadcast the dictionary is joined by shuffle, a hot label apart; no plan lists labels."""
    if labels == 1000:
        monkeypatch.setattr(stages, "settle", lambda t: settle(t, max_rows=100))
    rows = spark.range(2 * labels, numPartitions=8)
    label = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("l%07d", F.col("id") % labels))
    train = rows.select("id", label.alias("k"))
    want = train.select("k").distinct().count()
    model = CategoryCoder(inputCols=["k"], outputCols=["v"]).fit(train)
    assert not model.small and model.getOrDefault("sizes") == [want]
    test = train.where(F.col("id") < labels // 100).unionByName(spark.createDataFrame([(-1, "unseen"), (-2, None)], "id long, k string"))
    coded = model.transform(test)
    text = coded.select(F.col("id"), "k", F.col("v").cast("string").alias("v"))
    dictionary = model.table.select("v", "place").withColumnRenamed("v", "k")
    both = text.join(dictionary, "k", "left")
    right = F.when(F.col("place").isNull(), F.lit(f"({want},[],[])")).otherwise(
        F.concat(F.lit(f"({want},["), F.col("place").cast("string"), F.lit("],[1.0])"))
    )
    assert both.where(F.col("v") != right).count() == 0 and coded.count() == test.count()
    assert model.table.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (0, want - 1, want)
    assert model.table.where("v = 'hot'").first()["place"] == 0
