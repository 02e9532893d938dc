"""Linear models from one table of products, batched k-means and keyed permutations, beside plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabkit.operators import explain as X
from tabkit.operators import lloyd as L
from tabkit.operators.gram import GramModel, grams
from tabkit.session import scratch_path


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) * [1, 10, 0.1, 1] + [1000, 0, 5, 0]
    x = np.hstack([x, x[:, 1:2] + x[:, 3:4], np.ones((500, 1))])  # a dependent and a constant column
    y = x @ [1, 2, 3, 0, 0, 0] + rng.normal(size=500)
    frame = pd.DataFrame({"x": list(map(list, x)), "y": y, "p": np.arange(500) % 3})
    rows = spark.createDataFrame(frame).withColumn("features", array_to_vector("x")).repartition(5)
    return rows, x, y


def test_products_of_each_part(linear):
    rows, x, y = linear
    found = grams(rows.withColumn("y", F.when(F.col("p") < 2, F.col("y"))), "y", part=F.col("p"))
    assert set(found) == {0, 1} and grams(rows.where("p > 5"), "y") == {}
    for p, g in found.items():
        both = np.hstack([x, y[:, None]])[np.arange(500) % 3 == p]
        assert g.n == len(both) and np.allclose(g.mean, both.mean(0))
        gap = both - both.mean(0)
        assert np.allclose(g.products, gap.T @ gap, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("columns", [None, (0, 2), (1, 3, 4)])
def test_solutions_of_column_subsets(linear, columns):
    rows, x, y = linear
    table = grams(rows, "y")[0]
    mine = list(range(6)) if columns is None else list(columns)
    gap = x[:, mine] - x[:, mine].mean(0)
    for alpha in (0.0, 2.5):
        weights, constant = table.solve(columns, alpha)
        if alpha:
            want = np.linalg.solve(gap.T @ gap + alpha * np.eye(len(mine)), gap.T @ (y - y.mean()))
        else:
            want, *_ = np.linalg.lstsq(gap, y - y.mean(), rcond=1e-10)
        assert np.allclose(weights[mine], want, rtol=1e-6, atol=1e-6)
        assert np.allclose(np.delete(weights, mine), 0)
        assert constant == pytest.approx(y.mean() - x[:, mine].mean(0) @ want, rel=1e-6)


def test_linear_model_scores_and_is_saved(spark, linear):
    rows, x, y = linear
    model = GramModel.of(grams(rows, "y")[0].solve())
    path = scratch_path(spark, "linear")
    model.write().overwrite().save(path)
    got = {tuple(r["x"]): r["prediction"] for r in GramModel.load(path).transform(rows).collect()}
    want = x @ model.coefficients.toArray() + model.intercept
    assert np.allclose([got[tuple(v)] for v in x.tolist()], want) and np.corrcoef(want, y)[0, 1] > 0.99


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(80, 2)) + c for c in ((0, 0), (9, 0), (0, 20))])
    frame = pd.DataFrame({"id": np.arange(240), "x": list(map(list, x)), "g": np.repeat([0, 1, 2], 80)})
    df = spark.createDataFrame(frame)
    odd = df.limit(2).withColumn("x", F.when(F.col("id") == 0, F.array(F.lit(None).cast("double"), F.lit(1.0))))
    return L.points(df.unionByName(odd).repartition(4), F.col("x"), "id", "g"), x


def plain_lloyd(x, centres, rounds):
    for _ in range(rounds):
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([x[label == k].mean(0) if (label == k).any() else centres[k] for k in range(len(centres))])
    return centres


def test_all_sets_move_as_if_alone(groups):
    table, x = groups
    assert table.count() == 240  # rows with missing values go
    wanted = {0: 3, 1: 2, 2: 3, 5: 1}
    starts = L.draw_starts(table, wanted, 3)
    for name, k in wanted.items():
        assert starts[name].shape == (k, 2) and len(np.unique(starts[name], axis=0)) == k
        assert all((np.abs(x - c).sum(1) < 1e-12).any() for c in starts[name])
    sums = L.assign_round(table, starts)
    for name, centres in starts.items():
        moved = sums[name][:, 2:] / sums[name][:, :1]
        assert np.allclose(moved, plain_lloyd(x, centres, 1)) and sums[name][:, 0].sum() == 240
        assert sums[name][:, 1].sum() == pytest.approx(((x[:, None] - centres) ** 2).sum(2).min(1).sum())
    done, costs = L.many_kmeans(table, wanted, 3, tolerance=1e-20)
    assert set(done) == set(wanted)
    for name in wanted:
        assert np.allclose(done[name], plain_lloyd(x, starts[name], 50))
    best = L.best_starts({0: "a", 1: "b", 2: "a", 5: "c"}, costs)
    assert best["a"] == (0 if costs[0] <= costs[2] else 2) and best["b"] == 1


def test_silhouettes_are_those_of_all_pairs(groups):
    table, x = groups
    sets = {0: np.array([[0.0, 0], [9, 0], [0, 20]]), 4: np.array([[0.0, 0], [0, 20]]), 9: np.array([[3.0, 3]])}
    found = L.squared_silhouettes(table, sets)
    apart = ((x[:, None] - x) ** 2).sum(2)
    for name, centres in sets.items():
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        values = []
        for i, row in enumerate(apart):
            others = [row[label == k].mean() for k in set(label) - {label[i]}]
            inside = row[label == label[i]].sum() / (np.sum(label == label[i]) - 1)
            values.append((min(others) - inside) / max(min(others), inside) if others else 0)
        assert found[name] == pytest.approx(np.mean(values))
    labels = L.with_labels(table, sets, "g").collect()
    assert all(r["labels"][0] == r["g"] and r["labels"][2] == 0 for r in labels)


def test_few_and_no_rows(spark):
    same = L.points(spark.createDataFrame([([1.0, 2.0],)] * 5, "x array<double>"), F.col("x"))
    sets, costs = L.many_kmeans(same, {0: 2, 1: 1})
    assert costs == {0: 0.0, 1: 0.0} and len(sets[1]) == 1
    none = L.points(spark.createDataFrame([], "x array<double>"), F.col("x"))
    assert L.many_kmeans(none, {0: 2}) == ({}, {})


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 5000])
def test_bijection_reaches_every_number_once(spark, n):
    for key in (0, 7):
        to = spark.range(n).select(X.bijection(F.col("id"), n, F.lit(key).cast("long")).alias("to")).collect()
        assert sorted(r["to"] for r in to) == list(range(n))
    if n > 100:
        assert abs(np.corrcoef([r["to"] for r in to], np.arange(n))[0, 1]) < 0.15


def test_equal_rows_of_a_batch_are_measured_once(spark, monkeypatch):
    """Draws, sums, labels and silhouettes are those of all rows, however often rows repeat."""
    rng = np.random.default_rng(4)
    few = np.round(rng.normal(size=(30, 2)), 1)
    rows = [(int(i), [float(v) for v in few[i % 7 if i % 2 else rng.integers(30)]]) for i in range(3000)]
    table = L.points(spark.createDataFrame(rows, "id long, x array<double>").coalesce(2), F.col("x"), "id")
    wanted, found, asked = {0: 2, 1: 3, 2: 3}, [], []
    real = L._distinct
    assert len(real(np.array([r[1] for r in rows]))[0]) <= 30 and real(rng.normal(size=(3000, 2)))[1] is None
    for distinct in (lambda x: (x, None), real):
        monkeypatch.setattr(L, "_distinct", distinct)
        starts = L.draw_starts(table, wanted, 42)
        sums = L.assign_round(table, starts)
        labels = [r["labels"] for r in L.with_labels(table, starts, "id").orderBy("id").collect()]
        found.append((starts, sums, labels, L.squared_silhouettes(table, starts)))
    for n in wanted:
        assert (found[0][0][n] == found[1][0][n]).all() and np.allclose(found[0][1][n], found[1][1][n])
        assert np.isclose(found[0][3][n], found[1][3][n])
    assert found[0][2] == found[1][2]


def test_rounds_find_the_same_centres_in_single_precision():
    """Also where centres are equal, nearly equal or equally far, and for rows that single precision can't hold."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(700, 6))
    grid = np.round(rows * 2)
    for x in (rows, grid, rows + 3000, grid * 1e25, rows * 1e-25, np.zeros((70, 6))):
        for k in (1, 2, 5):
            centres = x[rng.integers(0, len(x), (9, k))]
            centres[1, -1] = centres[1, 0]
            centres[2, -1] = centres[2, 0] * (1 + 1e-12)
            centres[3] = (x[:k] + x[k : 2 * k]) / 2
            found, apart = L._nearest(x, centres, L._singles(centres)).T, L.distances(x, centres)
            own = np.take_along_axis(apart, found[..., None].astype(int), 2)[..., 0]
            assert (own - apart.min(2) <= 1e-13 * ((x**2).sum(1).max() + (centres**2).sum(2).max())).all()
            assert k == 1 or not (found[:, 1] == k - 1).any()
            if x is rows:
                assert (found == apart.argmin(2))[:, 4:].all()


def test_rounds_use_all_cores_and_sum_as_costs_do(spark):
    """Rows of one task were scanned by one task in each round, whatever the number of cores."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4))
    table = L.points(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>").coalesce(1), F.col("x"), "id")
    rows = L.dealt(table)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 3000 and max(sizes) < 500
    sets = {i: x[i * 4 : i * 4 + 2 + i % 3] for i in range(7)}
    moves, sums = L.move_round(rows, sets), L.assign_round(table, sets)
    for n in sets:
        assert (moves[n][:, 0] == sums[n][:, 0]).all() and np.allclose(moves[n][:, 1:], sums[n][:, 2:], rtol=1e-12, atol=1e-12)
    rows.unpersist()
