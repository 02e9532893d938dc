"""Boosting with an L2 term beside a plain loop, and the same trees from rows and from distinct rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabkit.operators import boosting as B
from tabkit.operators import trees as T
from tabkit.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 9, 700), rng.integers(0, 4, 700), rng.integers(0, 2, 700)], 1).astype(float)
    frame = pd.DataFrame({"x": list(map(list, x)), "y": 2 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=700)})
    rows = spark.createDataFrame(frame).repartition(3).withColumn("features", array_to_vector(F.col("x")))
    return rows, T.binned(rows, "y")


def plain(bins, y, p, rounds, start):
    """Predictions after some rounds of a recursive second-order tree."""
    pred = np.full(len(y), start)

    def grow(rows, depth, g):
        own = g[rows].sum() ** 2 / (len(rows) + p.l2)
        best = (1e-9, None, None)
        for f in range(bins.shape[1]) if depth < p.depth else ():
            for b in np.unique(bins[rows, f])[:-1]:
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if min(len(left), len(right)) >= p.least:
                    gain = g[left].sum() ** 2 / (len(left) + p.l2) + g[right].sum() ** 2 / (len(right) + p.l2) - own
                    if gain > best[0] + 1e-9:
                        best = (gain, left, right)
        if best[1] is None:
            out[rows] = -p.rate * g[rows].sum() / (len(rows) + p.l2)
        else:
            grow(best[1], depth + 1, g)
            grow(best[2], depth + 1, g)

    for _ in range(rounds):
        out = np.zeros(len(y))
        grow(np.arange(len(y)), 0, pred - y)
        pred = pred + out
    return pred


@pytest.mark.parametrize("cells", [20_000, 3])
def test_boosting_is_that_of_a_plain_loop(data, cells):
    _, binned = data
    p = B.Boosting(rounds=4, depth=3, rate=0.3, l2=7.0, least=5, rows=1.0, columns=1.0)
    trees = B.boost(binned, p, 5.0, rounds_per_store=2, most_cells=cells).orderBy("tree").collect()
    table = binned.table.orderBy("no").toArrow()
    _, y, _, bins = T.as_arrays(table, 3)
    pred = 5.0 + sum(t["value"][T.walk(t, bins)] for t in map(lambda r: T.read_piece(r.asDict()), trees))
    assert len(trees) == 4 and np.allclose(pred, plain(bins, y, p, 4, 5.0))


def test_stage_with_samples_is_saved_and_read(spark, data):
    rows, _ = data
    model = B.BoostedRegressor(labelCol="y", maxIter=6, maxDepth=3, stepSize=0.5).fit(rows)
    path = scratch_path(spark, "boosted")
    model.write().overwrite().save(path)
    values = [[r["prediction"] for r in m.transform(rows).collect()] for m in (model, B.BoostedModel.load(path))]
    y = np.array([r["y"] for r in rows.collect()])
    assert values[0] == values[1] and np.mean((y - values[0]) ** 2) < 0.2 * y.var()
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances[0] > 0.5
