import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabkit.operators import cluster as K
from tabkit.operators import profile as P


def test_duplicates_with_a_hot_row(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 1000).alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.lit("x")).alias("b"),
    )
    expected = df.count() - df.distinct().count()
    assert P.duplicate_rows(df).first()[0] == expected
    assert P.duplicate_rows(spark.range(10).toDF("a")).first()[0] == 0


def test_missing_counts_and_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), (None, None)], "x string, y string")
    row = P.agreement(df, "x", "y").first()
    assert (row["same_count"], row["different_count"], row["same_rate"]) == (1, 3, 0.25)
    got = [(r["column_name"], r["missing_count"], r["missing_rate"]) for r in P.missing_profile(df).collect()]
    assert got == [("x", 2, 0.5), ("y", 1, 0.25)]
    assert P.sparse_columns(df, 0.4) == ["x"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    got = P.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(np.histogram(np.arange(11.0), 5)[0])
    flat = P.histogram(spark.createDataFrame([(4.0,)] * 3, "x double"), "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0, 0, 3, 0, 0]


def test_describe_matches_pandas(spark):
    frame = pd.DataFrame({"x": [1.0, 2.0, 3.0, 10.0, np.nan]})
    row = P.describe(spark.createDataFrame([(None if np.isnan(v) else v,) for v in frame.x], "x double"), ["x"]).first()
    ours = [row[c] for c in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")]
    assert ours == pytest.approx(frame.x.describe().tolist())
    assert row["missing_count"] == 1


def test_correlation_is_pairwise_complete(spark):
    frame = pd.DataFrame({"a": [1, 2, 3, 4, np.nan], "b": [2, 1, np.nan, 5, 6], "c": [1, 1, 2, 2, 9.0]})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    got = P.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    expected = frame.corr()
    cells = got.collect()
    assert len(cells) == 9
    assert all(r["r"] == pytest.approx(expected.loc[r["a"], r["b"]]) for r in cells)


def test_column_families_overlap(spark):
    df = spark.createDataFrame([(1, None)], "`Water Use (kgal)` int, `Borough Water` int")
    got = {r["family"]: (r["n_columns"], r["filled_cells"]) for r in P.column_families(df).collect()}
    assert got == {"water": (2, 1), "building": (1, 0)}


def brute_silhouette(points, labels):
    out = []
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = gap[i, mine].sum() / (mine.sum() - 1)
        b = min(gap[i, labels == other].mean() for other in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    labels = np.array([0] * 30 + [1] * 25 + [2] * 20 + [3])
    points = rng.normal(size=(76, 2)) + labels[:, None] * [4.0, 2.0]
    frame = pd.DataFrame({"id": np.arange(76), "a": points[:, 0], "b": points[:, 1], "c": labels})
    return spark.createDataFrame(frame).withColumn("x", F.array("a", "b")).repartition(4), points, labels


def test_silhouette_against_brute_force(blobs):
    df, points, labels = blobs
    row = K.silhouette(df, "x", "c", "id").first()
    assert row["silhouette"] == pytest.approx(brute_silhouette(points, labels)) and row["n_sampled"] == 76
    blocked = K.silhouette(df, "x", "c", "id", sample_size=None, block=10).first()
    assert blocked["silhouette"] == pytest.approx(brute_silhouette(points, labels)) and blocked["n_sampled"] == 76
    assert K.silhouette(df, "x", "c", "id", sample_size=40).first()["n_sampled"] == 40


def test_adjusted_rand(spark, blobs):
    df, _, _ = blobs
    rows = df.withColumns({"same": F.col("c"), "swapped": 9 - F.col("c"), "one": F.lit(0), "other": F.lit(5)})
    got = {(r["first"], r["second"]): r["ari"] for r in K.adjusted_rand(rows, {k: k for k in ("c", "same", "swapped", "one", "other")}).collect()}
    assert got[("c", "same")] == pytest.approx(1.0) and got[("c", "swapped")] == pytest.approx(1.0)
    assert got[("c", "one")] == pytest.approx(0.0) and got[("one", "other")] == 1.0


def test_kmeans_sweep_and_inertia(blobs):
    df, points, labels = blobs
    got = K.k_sweep(df.where("c < 3"), ["a", "b"], "id", ks=(2, 3), seeds=(1, 2), starts=3).orderBy("k").collect()
    assert got[0]["inertia_mean"] > got[1]["inertia_mean"] and got[1]["stability_mean_ari"] > 0.9
    expected = sum(((points[labels == k] - points[labels == k].mean(0)) ** 2).sum() for k in range(4))
    assert K.inertia(df, ["a", "b"], "c").first()["inertia"] == pytest.approx(expected)


def test_names_follow_centres_not_ids(spark):
    for ids in ((0, 1, 2), (2, 0, 1)):
        centres = spark.createDataFrame(list(zip(ids, (9.0, 5.0, 1.0), (3.0, 8.0, 1.0))), "cluster int, e double, w double")
        got = {r["cluster"]: r["cluster_name"] for r in K.name_clusters(centres, "cluster", "e", "w").collect()}
        assert [got[i] for i in ids] == [K.HIGH_FIRST, K.HIGH_SECOND, K.LOW_BOTH]


def test_nearest_centre(spark):
    df = spark.createDataFrame([(0.0, 0.0), (9.0, 9.0), (5.0, 5.0), (None, 1.0)], "a double, b double")
    got = [r["cluster"] for r in K.nearest_centre(df, ["a", "b"], [(0, (0, 0)), (1, (10, 10))]).collect()]
    assert got == [0, 1, 0, None]
