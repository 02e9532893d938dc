"""Boosted regression trees with an L2 term, from the binned table of `trees`.

One job per level: each task sums gradients and second derivatives per (node, feature, bin) over its rows, Spark adds the
tasks' sums, and the driver picks the cuts; of two children only the left one is summed. What reaches the driver is
nodes x bins numbers, whatever the number of rows. The rows are kept as blocks of arrays, on disk where memory is short: these
jobs are per-partition loops over the same arrays, so they are run on the blocks themselves and not planned anew each
time. Predictions are checkpointed every `rounds_per_store` rounds; in between, tasks add the few trees since then. A
lost executor costs its blocks and its tasks of one level.

Without sampling of rows, the rounds depend on the rows only through count and summed label of each distinct row of bins.
Where these are few (proven by counting), one aggregate gives them all and the rounds are run on them without
further jobs; the result is the same.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators import trees as T
from tabkit.operators.stages import _TableModel
from tabkit.session import shared_dir, written


@dataclass(frozen=True)
class Boosting:
    """Rounds of trees: their depth, the rate, the penalty l2 * |leaf values|^2, and shares of rows and columns per tree."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    l2: float = 1.0
    least: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42


def chances(no: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number in [0, 1) per row and round, the same in every run."""
    x = no.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_033 + round_) * 0x8CB92BA72F3D8DD7 % 2**64)
    for turn in (30, 27):
        x = (x ^ (x >> np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _sums(bins: np.ndarray, columns: np.ndarray, offsets: np.ndarray, node: np.ndarray, g: np.ndarray, nodes: int, h: np.ndarray | None = None) -> np.ndarray:
    """(2 x nodes x bins of all columns): gradients and second derivatives, which are 1 a row for the squared error."""
    out = np.zeros((2, nodes, offsets[-1]))
    for i, f in enumerate(columns):
        width = offsets[i + 1] - offsets[i]
        key = node * width + bins[f]
        out[0, :, offsets[i] : offsets[i + 1]] = np.bincount(key, g, nodes * width).reshape(nodes, width)
        out[1, :, offsets[i] : offsets[i + 1]] = np.bincount(key, h, nodes * width).reshape(nodes, width)
    return out


def best_cuts(sums: np.ndarray, offsets: np.ndarray, p: Boosting) -> tuple[np.ndarray, ...]:
    """Per node: gain, place of the column and last bin on the left of the best cut; gradient and derivative of the node and
    of its left side."""
    first = slice(offsets[0], offsets[1])
    g, h = sums[0, :, first].sum(1), sums[1, :, first].sum(1)
    own = g * g / (h + p.l2)
    gain, column, cut = np.zeros(len(g)), np.full(len(g), -1), np.zeros(len(g), int)
    left = np.zeros((2, len(g)))
    for i in range(len(offsets) - 1):
        gl, hl = (s[:, offsets[i] : offsets[i + 1] - 1].cumsum(1) for s in sums)
        if not gl.shape[1]:
            continue
        gr, hr = g[:, None] - gl, h[:, None] - hl
        fit = (hl >= p.least) & (hr >= p.least)
        found = np.where(fit, gl * gl / (hl + p.l2) + gr * gr / (hr + p.l2) - own[:, None], -np.inf)
        at = found.argmax(1)
        node = np.arange(len(g))
        better = found[node, at] > gain + 1e-12 * own
        gain[better], column[better], cut[better] = found[node, at][better], i, at[better]
        left[:, better] = np.stack([gl[node, at], hl[node, at]])[:, better]
    return gain, column, cut, g, h, *left


def _blocks(data: T.Binned, start: float) -> RDD:
    """The rows as blocks of arrays (no, y, prediction, bins as columns x rows), one or a few in each partition."""
    spark = data.table.sparkSession
    cores, width = spark.sparkContext.defaultParallelism, len(data.borders)
    fit = max(1, min(cores, -(-data.rows // 10_000)))  # tasks of a few rows only cost time
    small = data.rows <= 10_000 * cores
    rows = data.table.select("no", "y", "part", "bins")
    rows = rows.repartition(fit, "no") if small else rows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                no, y, _, bins = T.as_arrays(batch, width)
                block = pickle.dumps((no, y, np.full(len(y), start), np.ascontiguousarray(bins.T)))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    # each of a round's six sums is a job over the same arrays: kept blocks spare it planning and conversion
    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(bytes(r["block"])))


def _summed(blocks: RDD, p: Boosting, round_: int, trees: list[dict], tree: dict | None, chosen: np.ndarray, offsets: np.ndarray, nodes: dict[int, int]) -> np.ndarray:
    """Sums over the rows drawn in this round for some nodes of the tree so far (node -> place)."""

    def add(held: Iterator[tuple]) -> Iterator[np.ndarray]:
        sums = None
        for no, y, pred, bins in held:
            rows = np.flatnonzero(chances(no, p.seed, round_) < p.rows) if p.rows < 1 else np.arange(len(no))
            mine = bins[:, rows]
            for made in trees:
                pred = pred + made["value"][T.walk(made, bins.T)]
            place = np.full(1 if tree is None else len(tree["feature"]), -1)
            place[list(nodes)] = list(nodes.values())
            at = place[np.zeros(len(rows), int) if tree is None else T.walk(tree, mine.T)]
            some = np.flatnonzero(at >= 0)
            part = _sums(mine[:, some], chosen, offsets, at[some], (pred - y)[rows][some], len(nodes))
            sums = part if sums is None else sums + part
        if sums is not None:
            yield sums

    parts = blocks.mapPartitions(add)
    if blocks.getNumPartitions() > 64:  # the driver gets a few sums, not one per task
        return parts.treeReduce(np.add, depth=2)
    return sum(parts.collect(), np.zeros((2, len(nodes), int(offsets[-1]))))


def one_tree(p: Boosting, round_: int, widths: np.ndarray, summed: Callable[..., np.ndarray]) -> dict:
    """The next tree; `summed` gives the sums of a level. The last level's leaves follow from the cuts above them."""
    chosen = np.sort(np.random.default_rng([p.seed, round_]).permutation(len(widths))[: max(1, math.ceil(p.columns * len(widths)))])
    offsets = np.append(0, np.cumsum(widths[chosen]))
    tree, sums, level = None, summed(None, chosen, offsets, {0: 0}), np.array([0])
    feature, cut, value, gains = [np.array([-1])], [np.array([0])], [np.zeros(1)], [np.zeros(1)]
    for depth in range(p.depth):
        gain, column, at, g, h, gl, hl = best_cuts(sums, offsets, p)
        if depth == 0:
            value[0][0] = -p.rate * g[0] / (h[0] + p.l2)
        split = column >= 0
        feature[-1], cut[-1], gains[-1] = np.where(split, chosen[column], -1), at, np.where(split, gain, 0)
        n = int(split.sum())
        if not n:
            break
        leaf = lambda g, h: -p.rate * g / (h + p.l2)
        below = np.stack([leaf(gl, hl), leaf(g - gl, h - hl)], 1)[split].ravel()
        for held, values in ((feature, np.full(2 * n, -1)), (cut, np.zeros(2 * n, int)), (value, below), (gains, np.zeros(2 * n))):
            held.append(values)
        if depth + 1 == p.depth:
            break
        level = int(level[-1]) + 1 + np.arange(2 * n)
        flat = np.concatenate(feature)
        tree = {"feature": flat, "cut": np.concatenate(cut), "left": T.lefts(flat)}
        left = summed(tree, chosen, offsets, {int(v): i for i, v in enumerate(level[0::2])})
        both = np.empty((2, 2 * n, offsets[-1]))
        both[:, 0::2], both[:, 1::2] = left, sums[:, split] - left
        sums = both
    made = {k: np.concatenate(v).astype(T._KINDS[k]) for k, v in zip(T._KINDS, (feature, cut, value, gains))}
    return made | {"left": T.lefts(made["feature"])}


def _over_cells(data: T.Binned, p: Boosting, start: float, widths: np.ndarray, most: int) -> list[dict] | None:
    """All trees from the distinct rows of bins, if there are at most `most`."""
    cells = data.table.groupBy("bins").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    rows = cells.limit(most + 1).collect()
    if len(rows) > most:
        return None
    rows.sort(key=lambda r: bytes(r["bins"]))
    bins = np.frombuffer(b"".join(bytes(r["bins"]) for r in rows), "u1").reshape(len(rows), -1)
    n, s = np.array([r["n"] for r in rows], float), np.array([r["s"] for r in rows])
    pred, made, columns = np.full(len(rows), start), [], np.ascontiguousarray(bins.T)
    for round_ in range(p.rounds):
        g = n * pred - s

        def summed(tree, chosen, offsets, nodes, g=g) -> np.ndarray:
            place = np.full(1 if tree is None else len(tree["feature"]), -1)
            place[list(nodes)] = list(nodes.values())
            at = place[np.zeros(len(bins), int) if tree is None else T.walk(tree, bins)]
            some = np.flatnonzero(at >= 0)
            return _sums(columns[:, some], chosen, offsets, at[some], g[some], len(nodes), n[some])

        made.append(one_tree(p, round_, widths, summed))
        pred = pred + made[-1]["value"][T.walk(made[-1], bins)]
    return made


def boost(data: T.Binned, p: Boosting, start: float, rounds_per_store: int = 25, most_cells: int = 20_000) -> DataFrame:
    """The trees of all rounds, as pieces of forest 0; their values are already scaled by the rate."""
    spark, widths = data.table.sparkSession, np.array([len(b) + 1 for b in data.borders])
    made = _over_cells(data, p, start, widths, most_cells) if p.rows >= 1 else None
    if made is None:
        made = _over_rows(data, p, start, widths, rounds_per_store)
    rows = [T._piece(0, i, 0, tree) for i, tree in enumerate(made)]
    return written(spark.createDataFrame(T._pieces(rows).to_pandas(), T.PIECES), "boosted")


def _over_rows(data: T.Binned, p: Boosting, start: float, widths: np.ndarray, rounds_per_store: int) -> list[dict]:
    """All trees by a job for each level of each round."""
    shared_dir(data.table.sparkSession)
    blocks = _blocks(data, start).persist(StorageLevel.MEMORY_AND_DISK)
    made: list[dict] = []
    recent: list[dict] = []
    for round_ in range(p.rounds):

        def summed(tree, chosen, offsets, nodes, now=blocks, round_=round_) -> np.ndarray:
            return _summed(now, p, round_, recent, tree, chosen, offsets, nodes)

        recent.append(one_tree(p, round_, widths, summed))
        made.append(recent[-1])
        if len(recent) == rounds_per_store and round_ + 1 < p.rounds:
            before, blocks, recent = blocks, _moved(blocks, recent), []
            blocks.checkpoint()  # a lost executor reads these predictions again, not the rounds before
            blocks.count()
            before.unpersist()
    blocks.unpersist()
    return made


def _moved(blocks: RDD, trees: list[dict]) -> RDD:
    def move(block: tuple) -> tuple:
        no, y, pred, bins = block
        return no, y, pred + sum(t["value"][T.walk(t, bins.T)] for t in trees), bins

    return blocks.map(move).persist(StorageLevel.MEMORY_AND_DISK)


class _Boosted(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most levels below the root", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "rate", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "penalty on squared leaf values", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a leaf", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows per tree", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "share of columns per tree, or all", TypeConverters.toString)
    borders = Param(Params._dummy(), "borders", "borders between the bins of each column", TypeConverters.identity)
    gains = Param(Params._dummy(), "gains", "importance of each column", TypeConverters.toListFloat)
    start = Param(Params._dummy(), "start", "prediction before the first round", TypeConverters.toFloat)


class BoostedRegressor(Estimator, _Boosted, DefaultParamsReadable, DefaultParamsWritable):
    """Gradient boosting of the squared error; the first prediction is the mean."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=300, maxDepth=6, stepSize=0.05,
                 l2=1.0, minInstancesPerNode=1.0, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42):
        super().__init__()
        self._setDefault(maxIter=300, maxDepth=6, stepSize=0.05, l2=1.0, minInstancesPerNode=1.0, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BoostedModel:
        get = self.getOrDefault
        data = T.binned(df, self.getLabelCol(), self.getFeaturesCol())
        start = float(data.table.agg(F.avg("y")).first()[0])
        share = 1.0 if get("featureSubsetStrategy") == "all" else float(get("featureSubsetStrategy"))
        p = Boosting(get("maxIter"), get("maxDepth"), get("stepSize"), get("l2"), get("minInstancesPerNode"), get("subsamplingRate"), share, self.getSeed())
        table = boost(data, p, start)
        gains = table.select("feature", "gain").collect()  # at most 2^(depth + 1) nodes a round
        share = np.zeros(len(data.borders))
        for r in gains:
            feature, gain = np.frombuffer(r["feature"], "<i2"), np.frombuffer(r["gain"], T._KINDS["gain"])
            share += np.bincount(feature[feature >= 0], gain[feature >= 0], len(share))
        model = self._copyValues(BoostedModel())
        model._set(borders=[b.tolist() for b in data.borders], gains=(share / (share.sum() or 1.0)).tolist(), start=start)
        model.table = table
        return model


class BoostedModel(_TableModel, _Boosted):
    """Fitted rounds; `table` holds one tree each."""

    def _hold(self, table: DataFrame) -> BoostedModel:
        self.table = table  # never joined to rows
        return self

    @property
    def featureImportances(self):
        return Vectors.dense(self.getOrDefault("gains"))

    def _transform(self, df: DataFrame) -> DataFrame:
        borders, rounds = [np.array(b) for b in self.getOrDefault("borders")], self.getOrDefault("maxIter")
        scored = T.with_forests(df, vector_to_array(F.col(self.getFeaturesCol())), self.table, borders, {0: [rounds]}, "__means")
        value = F.lit(self.getOrDefault("start")) + F.col("__means")[0] * rounds
        return scored.withColumn(self.getPredictionCol(), value).drop("__means")
