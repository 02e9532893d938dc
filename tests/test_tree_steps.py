"""Faster steps of forests give what the plain steps give, bit by bit."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabkit.operators import models as M
from tabkit.operators import trees as T
from tabkit.operators.coding import CategoryCoder


def test_draws_are_those_of_the_chances():
    no = np.concatenate([np.arange(300_000), np.arange(1000) * 8_589_934_592])
    x = no.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64((42 * 1_000_003 + 5) * 0xD1B54A32D192ED03 % 2**64)
    for turn in (30, 27):
        x = (x ^ (x >> np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    assert (T.drawn(no, 42, 5) == np.searchsorted(chances, (x >> np.uint64(11)) * 2.0**-53, "right")).all()
    assert len(T.drawn(no[:0], 42, 5)) == 0


def test_one_cut_columns_score_as_wide_ones():
    rng = np.random.default_rng(2)
    node, bin_, w, s = rng.integers(0, 40, 900), rng.integers(0, 2, 900), rng.integers(1, 4, 900).astype(float), rng.normal(size=900)
    bin_[node == 3] = 1
    for leaf in (1, 25):
        two, three = T._best_cuts(2 * node + bin_, w, s, 40, 2, leaf), T._best_cuts(3 * node + bin_, w, s, 40, 3, leaf)
        assert (two[0] == three[0]).all() and two[0][3] == -np.inf and (two[1] == 0).all()


def test_vectors_are_made_once_per_label(spark, capsys):
    rows = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "c string")
    model = CategoryCoder(inputCols=["c"], outputCols=["v"]).fit(rows)
    out = model.transform(spark.createDataFrame([("a",), (None,), ("z",), ("b",)], "c string"))
    assert [(r["c"], r["v"].toArray().tolist(), r["v"].size) for r in out.collect()] == [("a", [1, 0], 2), (None, [0, 0], 2), ("z", [0, 0], 2), ("b", [0, 1], 2)]
    out.explain()
    above = capsys.readouterr().out.partition("BroadcastHashJoin")[0]
    assert "__place" not in above  # rows take a vector; it is not written out from a number again


def _one_hot_rows():
    rng = np.random.default_rng(3)
    n, kinds = 30_000, 12
    kind = rng.choice(kinds, n, p=np.append(np.full(kinds - 1, 0.02), 1 - 0.02 * (kinds - 1)))
    wide = rng.integers(0, [40, 7, 90], (n, 3))
    flags = rng.integers(0, 2, (n, 2))
    bins = np.hstack([flags, wide, np.eye(kinds, dtype=int)[kind], np.zeros((n, 1), int)]).astype("u1")
    y = wide[:, 0] + 5.0 * (kind == 3) + 20.0 * flags[:, 0] * (kind == 5) + rng.integers(0, 3, n)  # ties between columns are many
    return bins, y, np.array([2, 2, 40, 7, 90, *[2] * kinds, 1])


@pytest.mark.parametrize("columns, depth", [(None, 30), (None, 3), (tuple(range(3, 17)), 30)])
def test_one_hot_columns_are_added_up_together(monkeypatch, columns, depth):
    bins, y, widths = _one_hot_rows()
    w = 1.0 + np.arange(len(y)) % 3
    g, seen, real = T.Growth(columns=columns, depth=depth), [], T._best_cuts
    monkeypatch.setattr(T, "_best_cuts", lambda key, *rest: seen.append(len(key)) or real(key, *rest))
    found = T.grow(bins, w, y, g, widths, T._rng(g, 0))
    together, seen[:] = sum(n for n in seen if n > 20_000), []
    monkeypatch.setattr(T, "_bundles", lambda *_: [])
    plain = T.grow(bins, w, y, g, widths, T._rng(g, 0))
    assert all(found[k].tobytes() == plain[k].tobytes() for k in plain)
    assert len(plain["feature"]) > 10 and together < 0.6 * sum(n for n in seen if n > 20_000)


def test_overlapping_columns_are_no_bundle():
    bins, _, widths = _one_hot_rows()
    (members, code), *more = T._bundles(np.ascontiguousarray(bins[:, 5:].T), np.arange(13), widths[5:])
    assert not more and members.tolist() == list(range(12)) and (bins[:, 5:17].argmax(1) + 1 == code).all()
    assert T._bundles(np.ascontiguousarray(bins[:, :2].T), np.arange(2), widths[:2]) == []


def test_masks_merge_cells():
    bins, y, widths = _one_hot_rows()
    bins, of = np.unique(bins, axis=0, return_inverse=True)
    n, s, q = (np.bincount(of.ravel(), v) for v in (np.ones(len(y)), y - 9.0, (y - 9.0) ** 2))
    cells = T.Cells(bins, np.where(np.arange(len(bins)) % 5 == 0, np.nan, 0.0), n, s, q, 9.0, None)
    g = T.Growth(columns=tuple(range(5, 17)), parts=(0,))
    masked = T._masked(cells, [g, T.Growth(), T.Growth(columns=tuple(range(17)))])
    assert list(masked) == [g.columns] and len(masked[g.columns][1]) == 2 * 12 and np.isnan(masked[g.columns][1]).sum() == 12
    merged, plain = (T._tree_of_cells((cells.bins, cells.part, 9.0, m), g, widths, 0, 0, n, s, q) for m in (masked, {}))
    assert np.allclose(merged["value"][T.walk(merged, bins)], plain["value"][T.walk(plain, bins)])


def test_small_tables_of_repeated_rows_grow_from_cells(spark, monkeypatch):
    rows = spark.range(4000, numPartitions=3).selectExpr("array(cast(id % 7 as double), cast(id % 2 as double)) AS x", "cast(id % 7 + id % 5 as double) AS y", "cast(id % 11 = 0 as int) AS part")
    rows = rows.withColumn("features", array_to_vector("x"))
    data = T.binned(rows, "y", "features", F.col("part"))
    forests = [T.Growth(trees=6, parts=(0,)), T.Growth(trees=3, bootstrap=False, parts=(0,))]

    def scores():
        found = T.held_out(data, forests, [[4, 6], [3]], [1]).orderBy("no").collect()
        return np.array([r["means"] for r in found]), T.tree_sizes(T.grow_forests(data, forests)).orderBy("forest", "tree").collect()

    small, sizes = scores()
    monkeypatch.setattr(T, "FEW_ROWS", 1000)
    monkeypatch.setattr(T, "as_arrays", lambda *_: pytest.fail("all rows are sent to the tasks"))
    cells, sizes_of_cells = scores()
    assert len(small) == 364 and np.allclose(small, cells) and [(r["depth"], r["nodes"]) for r in sizes] == [(r["depth"], r["nodes"]) for r in sizes_of_cells]


def test_folds_read_stored_rows(spark, monkeypatch):
    read, real = [], M.binned_rows
    monkeypatch.setattr(M, "binned_rows", lambda rows, *rest: read.append(rows.inputFiles()) or real(rows, *rest))
    rows = spark.range(300).selectExpr("id", "cast(id % 7 as double) AS x", "cast(id % 7 as double) AS y")
    errors = M.fold_errors(rows, M.Features(["x"]), "y", "id", [{"numTrees": 2, "bootstrap": False}])
    assert len(read) == 3 and all(files and files == read[0] for files in read) and "rows-to-fold" in read[0][0] and errors[0] < 1e-9


def test_cells_are_looked_up_without_a_table_on_the_driver(spark, monkeypatch):
    """Rows find their cells, and scores their rows, in sent arrays: no table of cells is made on the driver and broadcast by Spark."""
    monkeypatch.setattr(T, "FEW_ROWS", 1000)
    rows = spark.range(4000, numPartitions=3).selectExpr("array(cast(id % 7 as double), cast(id % 2 as double)) AS x", "cast(id % 7 as double) AS y", "nullif(cast(id % 3 as int), 2) AS part")
    data = T.binned(rows.withColumn("features", array_to_vector("x")), "y", "features", F.col("part"))
    cells = T.cells_of(data)
    found = T._in_cells(data.table, cells)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    own = {r["no"]: (r["part"], r["bins"]) for r in data.table.collect()}
    at = {r["no"]: r["cell"] for r in found.collect()}
    assert len(at) == 4000 and len(cells.n) == 7 * 2 * 3 and all((cells.bins[c].tobytes(), None if np.isnan(cells.part[c]) else cells.part[c]) == own[no][::-1] for no, c in at.items())
    trees = T.grow_forests(data, [T.Growth(trees=4, bootstrap=False)])
    scored = T.with_forests(rows, F.col("x"), trees, data.borders, {0: [1, 4]}, "m", most=0)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert all(np.allclose(r["m"], r["y"]) for r in scored.collect())


def test_borders_of_flags_come_from_their_ends(spark, monkeypatch):
    """One-hot columns are not sketched, and the sketches of the others come from a task per core; borders are as before."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 2, 900), np.zeros(900), rng.normal(size=900).round(2), rng.integers(0, 3, 900), np.ones(900)], 1)
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>").repartition(40)
    real, sketched = F.percentile_approx, []
    monkeypatch.setattr(T.F, "percentile_approx", lambda c, *rest: sketched.append(c) or real(c, *rest))
    found = T.borders_of(rows, F.col("x"), 5)
    assert len(sketched) == 2 and [b.tolist() for b in found if len(b) < 3] == [[0.5], [], [0.5, 1.5], []]
    values = [np.unique([x[:, 2].min(), x[:, 2].max(), *rows.agg(real(F.col("x")[2], [i / 253 for i in range(1, 253)], 10_000)).first()[0]])]
    assert (found[2] == (values[0][1:] + values[0][:-1]) / 2).all()
