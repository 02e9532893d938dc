"""Forests beside plain versions: a recursive tree, sums over all rows, and the same trees from both routes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabkit.operators import trees as T
from tabkit.session import scratch_path


def plain_tree(bins, w, y, g, depth=0):
    """Value of each row's leaf, by recursion; the first best cut in order of columns and bins."""
    keep = w > 0
    out = np.full(len(y), np.average(y[keep], weights=w[keep]))
    best = (1e-9, None, None)
    total, size = (w * y)[keep].sum(), w.sum()
    if depth < g.depth and size >= max(2 * g.leaf, g.split):
        for f in range(bins.shape[1]):
            for b in np.unique(bins[keep, f])[:-1]:
                left = bins[:, f] <= b
                lw, rw = w[left].sum(), w[~left].sum()
                if lw >= g.leaf and rw >= g.leaf:
                    gain = (w * y)[left].sum() ** 2 / lw + (w * y)[~left].sum() ** 2 / rw - total**2 / size
                    if gain > best[0] + 1e-9:
                        best = (gain, f, b)
    if best[1] is not None:
        left = bins[:, best[1]] <= best[2]
        out[left], out[~left] = plain_tree(bins[left], w[left], y[left], g, depth + 1), plain_tree(bins[~left], w[~left], y[~left], g, depth + 1)
    return out


@pytest.mark.parametrize("growth", [T.Growth(), T.Growth(leaf=5), T.Growth(depth=3, leaf=1), T.Growth(split=20, leaf=1), T.Growth(columns=(1, 2))])
def test_a_tree_is_that_of_plain_recursion(growth):
    rng = np.random.default_rng(3)
    bins = np.stack([rng.integers(0, k, 300) for k in (2, 200, 7, 1)], 1).astype("u1")
    y = rng.normal(size=300) + 3 * (bins[:, 1] > 90) + bins[:, 2]
    w = T.drawn(np.arange(300), 1, 0)
    made = T.grow(bins, w, y, growth, np.array([2, 200, 7, 1]), np.random.default_rng(0))
    seen = bins if growth.columns is None else bins[:, list(growth.columns)]
    drawn = w > 0  # equal cuts of the drawn rows may part the others differently
    assert np.allclose(made["value"][T.walk(made, bins)][drawn], plain_tree(seen, w, y, growth)[drawn])


def test_draws_are_poisson_and_repeat():
    w = T.drawn(np.arange(200_000), 42, 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.02 and (w == T.drawn(np.arange(200_000), 42, 7)).all()
    assert abs(np.corrcoef(w, T.drawn(np.arange(200_000), 42, 8))[0, 1]) < 0.02


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=900), rng.integers(0, 4, 900), rng.integers(0, 2, 900)], 1)
    frame = pd.DataFrame({"x": list(map(list, x)), "y": 2 * x[:, 0] + x[:, 1] + rng.normal(size=900), "role": rng.integers(0, 2, 900)})
    return spark.createDataFrame(frame).repartition(3).withColumn("features", array_to_vector(F.col("x")))


def test_large_tables_grow_the_same_trees(spark, rows):
    """Nodes split by histograms, and pieces below them, make the trees that a task makes alone."""
    data = T.binned(rows, "y", part=F.col("role"))
    forests = [T.Growth(trees=3), T.Growth(trees=2, leaf=7, parts=(1,), seed=3), T.Growth(trees=2, depth=2, bootstrap=False, columns=(0, 2))]
    marks = {0: [1, 3], 1: [2], 2: [2]}
    found = []
    for small_bytes, local_rows in ((1 << 30, 10), (0, 100), (0, 10_000)):
        trees = T.grow_forests(data, forests, local_rows, small_bytes)
        scored = T.with_forests(data.table, F.col("bins"), trees, data.borders, marks, "m", most=60_000).orderBy("no").collect()
        sizes = sorted(tuple(r) for r in T.tree_sizes(trees).select("forest", "tree", "depth", "nodes").collect())
        shares = T.importances(trees, 3)
        found.append((np.array([r["m"] for r in scored]), sizes, np.stack([shares[f] for f in range(3)])))
    for means, sizes, shares in found[1:]:
        # cuts that part the drawn rows equally may part the others differently, by the last bit of a sum
        assert np.isclose(means, found[0][0]).mean() > 0.9 and np.allclose(means[:, 3], found[0][0][:, 3])
        assert sizes == found[0][1] and np.allclose(shares, found[0][2], atol=0.02)
    assert max(d for _, _, d, _ in found[0][1]) > 6 and max(d for f, _, d, _ in found[0][1] if f == 2) == 2
    for small_bytes in (1 << 30, 0):
        held = T.held_out(data, forests, [marks[f] for f in range(3)], [0], small_bytes, local_rows=100).orderBy("no").collect()
        part = [r["part"] == 0 for r in data.table.orderBy("no").collect()]
        assert np.isclose(np.array([r["means"] for r in held]), found[0][0][part]).mean() > 0.9


def test_forest_stage_is_saved_and_read(spark, rows):
    model = T.ForestRegressor(labelCol="y", numTrees=20, featureSubsetStrategy="sqrt", seed=4).fit(rows)
    again = T.ForestRegressor(labelCol="y", numTrees=20, featureSubsetStrategy="sqrt", seed=4).fit(rows)
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    loaded = T.ForestModel.load(path)
    values = [[r["prediction"] for r in m.transform(rows).collect()] for m in (model, loaded, again)]
    assert values[0] == values[1] == values[2]
    y = np.array([r["y"] for r in rows.collect()])
    assert np.mean((y - values[0]) ** 2) < 0.7 * y.var()
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances[0] > 0.5
    assert model.sizes().count() == 20


def test_tables_that_teach_nothing(spark, rows):
    with pytest.raises(ValueError):
        T.ForestRegressor(labelCol="y").fit(rows.where("y IS NULL"))
    flat = rows.withColumn("y", F.lit(3.0))
    model = T.ForestRegressor(labelCol="y", numTrees=2).fit(flat.limit(1))
    assert {r["prediction"] for r in model.transform(flat).collect()} == {3.0} and {r["nodes"] for r in model.sizes().collect()} == {1}


def test_importances_of_pieces_without_a_split(spark):
    """A piece that is one leaf beside pieces with splits, in one task: what large tables make below their tops."""
    leaf = {"feature": np.array([-1]), "cut": np.array([0]), "value": np.array([1.0]), "gain": np.array([0.0])}
    split = {"feature": np.array([1, -1, -1]), "cut": np.array([3, 0, 0]), "value": np.array([1.0, 0.0, 2.0]), "gain": np.array([5.0, 0.0, 0.0])}
    pieces = [T._piece(0, 0, -1, split), T._piece(0, 0, 1, leaf), T._piece(0, 0, 2, split)]
    for order in (pieces, pieces[::-1]):
        trees = spark.createDataFrame(T._pieces(order).to_pandas(), T.PIECES).coalesce(1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        try:
            assert T.importances(trees, 3)[0].tolist() == [0, 1, 0]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows_of_bins_grow_the_same_trees(spark, monkeypatch):
    """Sums per distinct row of bins give the trees, held-out means and scores that all rows give."""
    monkeypatch.setattr(T, "CELL_ROWS", 2)
    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(0, k, 4000) for k in (5, 4, 3)], 1).astype(float)
    x[:1500] = x[0]  # a cell of many rows
    y = 1000 + 3 * x[:, 0] * x[:, 1] - x[:, 2] ** 2 + rng.normal(size=4000)
    frame = pd.DataFrame({"x": list(map(list, x)), "y": y, "role": np.where(rng.random(4000) < 0.02, np.nan, rng.integers(0, 3, 4000))})
    rows = spark.createDataFrame(frame).repartition(3).withColumn("features", array_to_vector(F.col("x")))
    data = T.binned(rows, "y", part=F.expr("nullif(role, 'NaN'::double)"))
    forests = [T.Growth(trees=4), T.Growth(trees=3, leaf=7, parts=(1,)), T.Growth(trees=2, seed=3, subset="sqrt", parts=(0, 2)), T.Growth(trees=2, bootstrap=False, columns=(0, 2))]
    marks = [[2, 4], [3], [2], [2]]
    assert len(T.cells_of(data).n) < 300 and T.cells_of(data, 1000) is None
    by, found = dict(enumerate(marks)), []
    for small_bytes in (1 << 30, 0):
        trees = T.grow_forests(data, forests, small_bytes=small_bytes)
        scored = [T.with_forests(data.table, F.col("bins"), trees, data.borders, by, "m", most).orderBy("no").collect() for most in (1 << 30, 0)]
        held = T.held_out(data, forests, marks, [0, 1], small_bytes).orderBy("no").collect()
        sizes = sorted(tuple(r) for r in T.tree_sizes(trees).collect())
        found.append((sizes, *[np.array([r[c] for r in some]) for some, c in ((scored[0], "m"), (scored[1], "m"), (held, "means"))], [tuple(r)[:3] for r in held]))
    assert found[0][0] == found[1][0] and found[0][4] == found[1][4] and len(found[0][4]) > 2000
    for some in (1, 2, 3):
        assert np.allclose(found[0][some], found[1][some])
    assert np.allclose(found[0][1], found[0][2])
