import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabkit.operators import quantiles as Q
from tabkit.operators.quantiles import quantiles
from tabkit.operators.ranks import assign_deciles, rank_rows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 30_000
    x = rng.lognormal(3, 2, n)
    x[rng.random(n) < 0.35] = 7.5
    g = rng.choice(["a", "b", "c"], n, p=[0.9, 0.09, 0.01])
    frame = pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "y": rng.normal(size=n)})
    return spark.createDataFrame(frame).repartition(8), frame


def test_direct_and_selected_quantiles_agree(skewed):
    df, frame = skewed
    wanted = {"p01": ("x", 0.01), "p50": ("x", 0.5), "p995": ("x", 0.995), "top": ("x", 1.0), "y25": ("y", 0.25)}
    for small in (10**9, 0):
        row = quantiles(df, wanted, small_rows=small).first()
        for alias, (c, q) in wanted.items():
            assert row[alias] == pytest.approx(frame[c].quantile(q), rel=1e-12)


def test_selected_quantiles_by_group(skewed):
    df, frame = skewed
    out = quantiles(df, {"med": ("x", 0.5), "q9": ("y", 0.9)}, by=["g"], small_rows=0).collect()
    assert len(out) == 3
    for row in out:
        mine = frame[frame.g == row["g"]]
        assert row["med"] == pytest.approx(mine.x.median(), rel=1e-12)
        assert row["q9"] == pytest.approx(mine.y.quantile(0.9), rel=1e-12)


def test_narrowing_rounds(skewed, monkeypatch):
    df, frame = skewed
    monkeypatch.setattr(Q, "FINISH_VALUES", 20)
    row = quantiles(df, {"a": ("y", 0.33), "b": ("x", 0.4)}, small_rows=0).first()
    assert row["a"] == pytest.approx(frame.y.quantile(0.33), rel=1e-12)
    assert row["b"] == pytest.approx(frame.x.quantile(0.4), rel=1e-12)


@pytest.mark.parametrize("n", [1, 2, 11, 12, 1003])
def test_tiny_selected_quantiles(spark, n):
    frame = pd.DataFrame({"x": np.random.default_rng(n).normal(size=n)})
    df = spark.createDataFrame(frame)
    row = quantiles(df, {"a": ("x", 0.25), "b": ("x", 0.99)}, small_rows=0).first()
    assert row["a"] == pytest.approx(frame.x.quantile(0.25))
    assert row["b"] == pytest.approx(frame.x.quantile(0.99))


@pytest.mark.parametrize("small", [0, 10**9])
def test_deciles_match_a_quantile_cut_of_ranks(skewed, small):
    df, frame = skewed
    ordered = frame.sort_values(["x", "id"]).reset_index(drop=True)
    ordered["k"] = pd.qcut(np.arange(1, len(frame) + 1), 10, labels=False) + 1
    expected = dict(zip(ordered.id, ordered.k))
    got = assign_deciles(df, "x", "id", "d", "Target Decile", small_rows=small).select("id", "d").toPandas()
    assert all(f"Target Decile {expected[i]}" == d for i, d in zip(got.id, got.d))


@pytest.mark.parametrize("small", [0, 10**9])
@pytest.mark.parametrize("n", [1, 2, 12])
def test_small_deciles_with_missing(spark, n, small):
    df = spark.createDataFrame(
        [(i, float(i // 2)) for i in range(n)] + [(100, None)], "id long, v double"
    )
    got = {r["id"]: r["d"] for r in assign_deciles(df, "v", "id", "d", "D", small_rows=small).collect()}
    assert got[100] is None
    if n == 1:
        assert got[0] is None
    if n == 12:
        cut = pd.qcut(np.arange(1, 13), 10, labels=False) + 1
        assert [got[i] for i in range(12)] == [f"D {k}" for k in cut]


def test_rank_rows(skewed):
    df, frame = skewed
    ranked = rank_rows(df, "x", "id").select("id", "rn").toPandas()
    expected = frame.sort_values(["x", "id"]).reset_index(drop=True)
    expected["rn"] = np.arange(1, len(frame) + 1)
    merged = ranked.merge(expected[["id", "rn"]], on="id")
    assert (merged.rn_x == merged.rn_y).all() and len(merged) == len(frame)


def test_rank_rows_of_empty_tables_and_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert [r["rn"] for r in rank_rows(df, "v", "id").collect()] == [None, None]
    assert rank_rows(df.limit(0), "v", "id").collect() == []


@pytest.mark.parametrize("small", [0, 10**9])
def test_quantiles_without_values(spark, small):
    rows = [("a", 1.0, None), ("a", 3.0, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    wanted = {"x": ("x", 0.5), "y": ("y", 0.5)}
    found = {r["g"]: (r["x"], r["y"]) for r in quantiles(df, wanted, by=["g"], small_rows=small).collect()}
    assert found == {"a": (2.0, None), "b": (None, None)}
    assert quantiles(df, wanted, small_rows=small).first().asDict() == {"x": 2.0, "y": None}
    assert quantiles(df, {"y": ("y", 0.5)}, small_rows=small).first()["y"] is None
    assert quantiles(df.limit(0), wanted, small_rows=small).first().asDict() == {"x": None, "y": None}


@pytest.mark.parametrize("small", [0, 10**9])
@pytest.mark.parametrize("key", ["id + 1152921504606846976L", "xxhash64(id)", "concat('row number ', lpad(id, 9, '0'))", "concat('k', id)"])
def test_deciles_with_keys_of_any_kind(spark, key, small):
    df = spark.range(3000, numPartitions=4).selectExpr("id", "cast(id div 700 as double) as v", f"{key} as k")
    frame = df.toPandas().sort_values(["v", "k"]).reset_index(drop=True)
    expected = dict(zip(frame.id, pd.qcut(np.arange(1, 3001), 10, labels=False) + 1))
    got = assign_deciles(df, "v", "k", "d", "D", small_rows=small).select("id", "d").collect()
    assert all(r["d"] == f"D {expected[r['id']]}" for r in got) and len(got) == 3000


def test_text_values_have_deciles(spark):
    df = spark.range(500).selectExpr("id", "concat('name ', lpad(id % 37, 4, '0')) as v")
    small, large = ({r["id"]: r["d"] for r in assign_deciles(df, "v", "id", "d", "D", small_rows=n).collect()} for n in (10**9, 0))
    assert small == large


def test_describing_four_columns_reads_them_together(skewed):
    df, _ = skewed
    context = df.sparkSession.sparkContext
    context.setJobGroup("count jobs", "")
    wanted = {f"{c}{q}": (F.col("x") * c, q) for c in (1, 2, 3, 4) for q in (0.25, 0.5, 0.75)}
    quantiles(df, wanted, small_rows=0, known_rows=30_000).collect()
    jobs = context.statusTracker().getJobIdsForGroup("count jobs")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 8


def test_infinite_quantiles_on_the_large_route(spark):
    from tabkit.operators.quantiles import quantiles

    rows = spark.createDataFrame([(x,) for x in [1.0, 2.0, float("inf"), float("inf"), float("inf")]], "x double")
    for small in (10, 0):
        found = quantiles(rows, {"mid": ("x", 0.5), "low": ("x", 0.25), "top": ("x", 0.9)}, small_rows=small).first()
        assert (found["low"], found["mid"], found["top"]) == (2.0, float("inf"), float("inf"))
