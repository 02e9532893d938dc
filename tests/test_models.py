import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabkit.operators import explain as X
from tabkit.operators import models as M
from tabkit.operators.stages import RidgeRegression
from tabkit.session import scratch_path
from tabkit.sources import artefacts


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 400
    c = rng.choice(["u", "v", "w"], n)
    frame = pd.DataFrame({"id": np.arange(n), "x1": rng.normal(size=n), "x2": rng.normal(size=n), "c": c})
    frame["y"] = 3 * frame.x1 + frame.c.map({"u": 0.0, "v": 4.0, "w": 8.0}) + rng.normal(scale=0.1, size=n) + 10
    return spark.createDataFrame(frame).withColumn("held", F.col("id") % 5 == 0), frame


FEATURES = M.Features(["x1", "x2"], ["c"], min_category_count=5)


def test_comparison_beats_the_mean(planted):
    df, _ = planted
    models = M.candidate_models(FEATURES, "y", "c", dummy=True, forest_settings={"numTrees": 10, "maxDepth": 8}, boosted_settings={"maxIter": 10, "stepSize": 0.3})
    metrics, fitted, scored = M.compare_models(df.where("not held"), df.where("held"), models, "y", clip_at_zero=True)
    rmse = {r["model"]: r["rmse"] for r in metrics.collect()}
    assert set(rmse) == {"mean", "category_mean", "linear", "ridge", "forest", "boosted"}
    assert rmse["linear"] < 0.2 and rmse["ridge"] < 0.3
    assert rmse["forest"] < rmse["category_mean"] < rmse["mean"] and rmse["boosted"] < rmse["mean"]
    assert min(scored.columns.index(f"pred_{n}") for n in fitted) >= len(df.columns)
    assert [r["rmse"] for r in metrics.collect()] == sorted(rmse.values())
    names = X.feature_names(fitted["forest"].transform(df), FEATURES)
    assert names == ["x1", "x2", "c=u", "c=v", "c=w"]
    top = X.feature_effects(fitted["linear"], fitted["linear"].transform(df), FEATURES, "linear").first()
    assert top["feature"] in ("c=u", "c=w") and top["metric_type"] == "coefficient"
    importance = X.permutation_importance(fitted["forest"].transform, df.where("held"), ["x1", "x2", "c"], "y", "id", repeats=2)
    got = {r["feature"]: r["importance_mean"] for r in importance.collect()}
    assert got["c"] > 1 and got["x1"] > 1 and abs(got["x2"]) < 0.5


def test_least_squares_is_the_smallest_solution(planted):
    """Also for a category never seen, where only the smallest solution is defined."""
    df, frame = planted
    model = M.recipe(FEATURES, M.least_squares("y"), scaled=True).fit(df)
    z = ((frame[["x1", "x2"]] - frame[["x1", "x2"]].mean()) / frame[["x1", "x2"]].std(ddof=0)).to_numpy()
    hot = pd.get_dummies(frame.c).to_numpy(float)
    design = np.hstack([z, hot])
    centre = design.mean(axis=0)
    beta, *_ = np.linalg.lstsq(design - centre, frame.y - frame.y.mean(), rcond=None)
    got = model.stages[-1].coefficients.toArray()
    assert np.allclose(got, beta, atol=1e-4)
    assert model.stages[-1].intercept == pytest.approx(frame.y.mean() - centre @ beta, abs=1e-3)


def test_ridge_matches_the_closed_form(spark, planted):
    df, frame = planted
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)
    model = RidgeRegression(alpha=25.0, labelCol="y").fit(rows)
    x = frame[["x1", "x2"]].to_numpy() - frame[["x1", "x2"]].to_numpy().mean(axis=0)
    beta = np.linalg.solve(x.T @ x + 25.0 * np.eye(2), x.T @ (frame.y - frame.y.mean()))
    assert np.allclose(model.coefficients.toArray(), beta, rtol=1e-6)


def test_tuning_and_saved_model(spark, planted):
    df, _ = planted
    train = df.where("not held")
    table, best, model = M.validation_search(train, FEATURES, "y", "id", {"shallow": {"maxDepth": 1}, "deep": {"maxDepth": 8}}, smaller={"numTrees": 5})
    assert best == "deep" and table.count() == 2
    search, setting, _ = M.random_search(train, FEATURES, "y", "id", {"numTrees": [3], "maxDepth": [1, 6]}, draws=2)
    assert setting["maxDepth"] == 6 and search.count() == 2
    path = artefacts.save_model(spark, model, scratch_path(spark, "tuned"), {"model_name": best})
    loaded, about = artefacts.load_model(spark, path)
    assert about == {"model_name": "deep"}
    before = {r["id"]: r["prediction"] for r in artefacts.score(model, df).collect()}
    assert before == {r["id"]: r["prediction"] for r in artefacts.score(loaded, df).collect()}
    assert X.tree_statistics(loaded, spark).first()["n_trees"] == 5
    assert X.vector_width(loaded.transform(df)) == 5


def test_missing_category_modes(spark, planted):
    df, _ = planted
    gaps = df.withColumn("c", F.when(F.col("id") % 7 > 0, F.col("c"))).withColumn("x1", F.when(F.col("id") % 11 > 0, F.col("x1")))
    for mode, width in (("label", 6), ("mode", 5)):
        features = M.Features(["x1", "x2"], ["c"], mode, min_category_count=5, group_fill={"x1": "c"})
        model = M.recipe(features, M.least_squares("y")).fit(gaps)
        scored = model.transform(gaps)
        assert scored.count() == 400 and X.vector_width(scored) == width


def test_permutation_guards(planted):
    df, _ = planted
    with pytest.raises(ValueError):
        X.permutation_importance(lambda d: d, df.where("id < 0"), ["x1"], "y", "id")
