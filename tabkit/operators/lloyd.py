"""k-means for many sets of centres at once: one scan of the rows per round moves all of them.

A set is one start: a number of clusters and a seed. Starts are drawn by k-means++: in each scan every set draws one more
centre, by a race of exponential clocks that run at the squared distance to the centres so far, so a draw needs no
second look. Then rounds: each task multiplies its rows with all open sets' centres, and returns count and sum per
set and cluster; Spark adds these up per set. Equal rows of a batch are measured once. A set whose centres hardly move is closed and leaves the following scans.
Rounds find the nearest centres in single precision, and measure rows again in double precision where two centres are too close to tell; sums are
always of doubles. Inertia, labels and silhouettes come from one more scan each, in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.session import written

Sets = dict[int, np.ndarray]  # name of the set -> centres (clusters x columns)
CELLS = 4_000_000  # (row, centre) pairs that are held at a time
KEPT_BYTES = 128 << 20  # rows that an executor keeps between rounds, for each core
NEAR_CELLS = 262_144  # the same for rounds, whose arrays should fit a core's cache


def points(df: DataFrame, x: Column, *keep: str) -> DataFrame:
    """The rows as a stored table of `no`, `x` (an array) and the kept columns; rows with missing values go."""
    rows = df.select(*keep, x.cast("array<double>").alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return written(rows.withColumn("no", F.monotonically_increasing_id()), "points")


def dealt(table: DataFrame) -> DataFrame:
    """`no` and `x` of `points`, for many scans: x as the bytes of its doubles, which Spark hands to tasks as they are.

    Rows that few tasks would have most of are dealt evenly to all cores. They are kept by the executors, or, if these are more than
    `KEPT_BYTES` a core and dealt already, stored in the shared folder.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 4096):
            packed = pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("no"), packed], names=["no", "x"])

    packed = table.select("no", "x").mapInArrow(pack, "no long, x binary")
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    tasks = min(table.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // 250))
    if sizes and max(sizes) * tasks > 1.25 * sum(sizes):
        packed = packed.repartition(tasks, "no")
    elif sizes and 8 * table.select(F.size("x")).first()[0] * sum(sizes) > KEPT_BYTES * tasks:
        return written(packed, "packed")
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            x = part.column("x")
            if pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
                values = x.flatten().to_numpy(zero_copy_only=False)
            else:
                x = x.cast(pa.large_binary())
                _, ends, data = x.buffers()
                at = np.frombuffer(ends, "i8", len(x) + 1, 8 * x.offset)
                values = np.frombuffer(data, "u1")[at[0] : at[-1]].copy().view("f8")
            yield part, values.reshape(part.num_rows, -1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The distinct rows and which of them each row is, if many rows of a batch are equal; else the rows and None."""
    key = np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel() if x.size else np.empty(0)
    if len(key) < 64 or 2 * len(np.unique(key[:1024])) > len(key[:1024]):
        return x, None
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return x[first], of.ravel()


def _stacks(sets: Sets) -> list[tuple[list[int], np.ndarray]]:
    """Sets of equal size together: their names and centres (sets x clusters x columns)."""
    by: dict[int, list[int]] = {}
    for name, centres in sets.items():
        by.setdefault(len(centres), []).append(name)
    return [(names, np.stack([sets[n] for n in names])) for _, names in sorted(by.items())]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows x sets x clusters)."""
    flat = centres.reshape(-1, centres.shape[-1])
    found = x @ (-2 * flat).T
    found += (x**2).sum(1)[:, None]
    found += (flat**2).sum(1)
    return np.maximum(found, 0, out=found).reshape(len(x), *centres.shape[:2])


def _singles(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For `_nearest`: the middle of the centres, what rows around it are multiplied with (clusters and sets x columns), and the largest square."""
    middle = centres.mean((0, 1))
    flat = (centres - middle).transpose(1, 0, 2).reshape(-1, centres.shape[2])
    square = (flat**2).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        return middle, np.hstack([-2 * flat, square[:, None]]).astype("f4"), float(square.max())


def _nearest(x: np.ndarray, centres: np.ndarray, singles: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """The nearest centre of each row in each set (sets x rows), as `distances` has it.

    Products are of single precision. Where the two least distances differ by no more than their errors can, the row is measured again.
    """
    n_sets, k, width = centres.shape
    kind = np.dtype("u1" if k <= 256 else "u4")
    label = np.zeros((n_sets, len(x)), kind)
    if k == 1:
        return label
    middle, factors, square = singles
    near = x - middle
    # each product of n terms errs by at most n + 2 roundings of the sum of their sizes, the two sides alike
    size = 2 * np.sqrt((near**2).sum(1).max(initial=0) * square) + square
    unsure = np.float32(min(2.0**-22 * (width + 3) * size, 3e38))
    with np.errstate(over="ignore", invalid="ignore"):
        found = factors @ np.hstack([near, np.ones((len(x), 1))]).astype("f4").T
        found = found.reshape(k, n_sets, len(x))
        least, second, larger = found[0].copy(), np.full(label.shape, np.inf, "f4"), np.empty(label.shape, "f4")
        nearer = np.empty(label.shape, kind)
        for i in range(1, k):
            np.less(found[i], least, out=nearer, casting="unsafe")
            np.maximum(label, np.multiply(nearer, kind.type(i), out=nearer), out=label)
            np.maximum(least, found[i], out=larger)
            np.minimum(second, larger, out=second)
            np.minimum(least, found[i], out=least)
        again = ~(second - least > unsure)
    if 8 * np.count_nonzero(again) > again.size:
        return distances(x, centres).argmin(2).T
    name, row = np.nonzero(again)
    for i in range(0, len(row), 4096):
        n, r = name[i : i + 4096], row[i : i + 4096]
        gaps = (x[r] ** 2).sum(1)[:, None] - 2 * np.einsum("rd,rkd->rk", x[r], centres[n]) + (centres[n] ** 2).sum(2)
        label[n, r] = np.maximum(gaps, 0).argmin(1)
    return label


def _rows_for(sets: Sets) -> int:
    return max(64, CELLS // max(1, sum(map(len, sets.values()))))


def _least(found: np.ndarray) -> np.ndarray:
    """`found.min(2)`, fast for few clusters."""
    out = found[:, :, 0].copy()
    for i in range(1, found.shape[2]):
        np.minimum(out, found[:, :, i], out=out)
    return out


def _chances(no: np.ndarray, name: int, step: int, seed: int) -> np.ndarray:
    """A number in (0, 1) per row, the same in every run."""
    x = no.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((name * 1009 + step) * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % 2**64)
    for turn in (30, 27):
        x = (x ^ (x >> np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def draw_starts(table: DataFrame, wanted: Mapping[int, int], seed: int) -> Sets:
    """Centres of each set (name -> number of clusters) by k-means++, one scan per cluster of the largest set."""
    sets: Sets = {}
    for step in range(max(wanted.values(), default=0)):
        open_ = [n for n, k in wanted.items() if k > step]
        held = {n: sets[n] for n in open_ if n in sets}
        sent = table.sparkSession.sparkContext.broadcast((open_, held))

        def race(batches: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            names, held = sent.value
            best: dict[int, tuple[float, np.ndarray]] = {}
            for part, x in _matrices(batches, _rows_for(held) if held else 4096):
                no = part.column("no").to_numpy()
                x, of = _distinct(x)
                if of is not None:  # equal rows run at one speed: the first of them is the one with the largest chance
                    order = np.argsort(of, kind="stable")
                    no, starts = no[order], np.searchsorted(of[order], np.arange(len(x)))
                near = {n: d for group, c in _stacks(held) for n, d in zip(group, _least(distances(x, c)).T)} if held else {}
                for n in names:
                    rate = near.get(n, np.ones(len(x)))
                    chance = _chances(no, n, step, seed)
                    chance = chance if of is None else np.maximum.reduceat(chance, starts)
                    clock = np.divide(-np.log(chance), rate, out=np.full(len(x), np.inf), where=rate > 0)
                    at = int(clock.argmin())
                    if n not in best or clock[at] < best[n][0]:
                        best[n] = (float(clock[at]), x[at].copy())
            if best:
                columns = [pa.array(list(best), pa.int32()), pa.array([c for c, _ in best.values()]), pa.array([v for _, v in best.values()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "clock", "x"])

        found = table.select("no", "x").mapInArrow(race, "name int, clock double, x array<double>")
        for r in found.groupBy("name").agg(F.min_by("x", "clock").alias("x")).collect():
            row = np.array(r["x"])[None]
            sets[r["name"]] = np.concatenate([sets[r["name"]], row]) if r["name"] in sets else row
    return sets


def assign_round(table: DataFrame, sets: Sets) -> dict[int, np.ndarray]:
    """Per set, for each cluster: number of rows, summed squared distances, and sums of the columns."""
    sent = table.sparkSession.sparkContext.broadcast(sets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = sent.value, {}
        stacks = _stacks(sets)
        for _, x in _matrices(batches, _rows_for(sets)):
            x, of = _distinct(x)
            times = np.ones(len(x)) if of is None else np.bincount(of, minlength=len(x)).astype(float)
            wide = np.hstack([np.ones((len(x), 1)), np.zeros((len(x), 1)), x]) * times[:, None]
            for names, centres in stacks:
                found = distances(x, centres)
                label = found.argmin(2)
                cost = np.take_along_axis(found, label[..., None], 2)[..., 0]
                k = centres.shape[1]
                member = np.zeros((len(x), len(names) * k))
                member[np.arange(len(x))[:, None], np.arange(len(names)) * k + label] = 1
                sums = (member.T @ wide).reshape(len(names), k, -1)
                for i, n in enumerate(names):
                    sums[i, :, 1] = np.bincount(label[:, i], cost[:, i] * times, k)
                    held[n] = held[n] + sums[i] if n in held else sums[i]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["name", "sums"])

    return _totals(table, sets, add)


def move_round(table: DataFrame, sets: Sets) -> dict[int, np.ndarray]:
    """Per set, for each cluster: number of rows and sums of the columns, as `assign_round` has them, without the distances."""
    sent = table.sparkSession.sparkContext.broadcast(sets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = sent.value
        stacks = _stacks(sets)
        singles = [_singles(centres) for _, centres in stacks]
        held = [0.0] * len(stacks)
        rows = max(64, NEAR_CELLS // max((c.shape[0] * c.shape[1] for _, c in stacks), default=1))
        for _, x in _matrices(batches, rows):
            x, of = _distinct(x)
            times = np.ones(len(x)) if of is None else np.bincount(of, minlength=len(x)).astype(float)
            wide = np.ascontiguousarray((np.hstack([np.ones((len(x), 1)), x]) * times[:, None]).T)
            for i, (names, centres) in enumerate(stacks):
                label, k = _nearest(x, centres, singles[i]), centres.shape[1]
                member = np.empty((k, *label.shape))
                for j in range(k):
                    member[j] = label == j
                held[i] = held[i] + wide @ member.reshape(k * len(names), -1).T
        if stacks and not np.isscalar(held[0]):
            each = [(n, v) for (names, c), h in zip(stacks, held) for n, v in zip(names, h.T.reshape(c.shape[1], len(names), -1).transpose(1, 0, 2))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in each], pa.int32()), pa.array([v.tobytes() for _, v in each], pa.binary())], names=["name", "sums"])

    return _totals(table, sets, add)


def _totals(table: DataFrame, sets: Sets, add: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[int, np.ndarray]:
    """The sums of all tasks' `add`, per set."""
    tasks = max(1, min(len(sets), table.sparkSession.sparkContext.defaultParallelism))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, v in zip(batch.column("name").to_pylist(), batch.column("sums").to_pylist()):
                held[n] = held.get(n, 0) + np.frombuffer(v, "f8")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["name", "sums"])

    kind = "name int, sums binary"
    found = table.select("x").mapInArrow(add, kind).repartition(tasks, "name").mapInArrow(total, kind).collect()
    return {r["name"]: np.frombuffer(r["sums"], "f8").reshape(len(sets[r["name"]]), -1) for r in found}


def many_kmeans(table: DataFrame, wanted: Mapping[int, int], seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> tuple[Sets, dict[int, float]]:
    """Centres and inertia of each set. A set is closed when its centres move, squared and summed, by at most `tolerance` times the
    mean variance of the columns; a cluster that loses all rows keeps its centre."""
    spread = table.select(F.posexplode("x")).groupBy("pos").agg(F.var_pop("col").alias("v")).agg(F.avg("v")).first()[0] or 0.0
    rows = dealt(table)
    try:
        open_ = draw_starts(rows, wanted, seed)
        done: Sets = {}
        for round_ in range(rounds):
            if not open_:
                break
            for name, sums in move_round(rows, open_).items():
                n = sums[:, :1]
                moved = np.where(n > 0, sums[:, 1:] / np.maximum(n, 1), open_[name])
                if ((moved - open_[name]) ** 2).sum() <= tolerance * spread or round_ == rounds - 1:
                    done[name] = open_.pop(name)  # the cost is that of these centres
                else:
                    open_[name] = moved
        costs = {name: float(sums[:, 1].sum()) for name, sums in assign_round(rows, done).items()} if done else {}
    finally:
        rows.unpersist()
    return done, costs


def best_starts(wanted: Mapping[int, object], costs: Mapping[int, float]) -> dict[object, int]:
    """For each group of sets (name -> group), the name of the one with the least cost, the first of equal ones."""
    best: dict[object, int] = {}
    for name in sorted(wanted):
        group = wanted[name]
        if name in costs and (group not in best or costs[name] < costs[best[group]]):
            best[group] = name
    return best


def with_labels(table: DataFrame, sets: Sets, *keep: str) -> DataFrame:
    """The kept columns, x, and `labels`: the nearest centre of each set, in the order of the sets' names."""
    sent = table.sparkSession.sparkContext.broadcast(dict(sorted(sets.items())))
    order = {n: i for i, n in enumerate(sorted(sets))}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, _rows_for(sent.value)):
            found = np.empty((len(x), len(order)), "i4")
            x, of = _distinct(x)
            for names, centres in _stacks(sent.value):
                label = distances(x, centres).argmin(2)
                found[:, [order[n] for n in names]] = label if of is None else label[of]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(found), pa.list_(pa.int32()))], names=[*part.schema.names, "labels"])

    rows = table.select(*keep, "x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(label, f"{schema}, labels array<int>")


def squared_silhouettes(table: DataFrame, sets: Sets) -> dict[int, float]:
    """Mean silhouette of squared distances over all rows, per set: one scan for sums, one for the rows' values.

    The mean squared distance to a cluster follows from its count, sum and summed squares. Rows alone in their cluster count 0.
    """
    about = {n: s for n, s in assign_round(table, sets).items()}
    sent = table.sparkSession.sparkContext.broadcast((sets, about))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, about = sent.value
        held = {n: 0.0 for n in sets}
        for _, x in _matrices(batches, _rows_for(sets)):
            x, of = _distinct(x)
            times = np.ones(len(x)) if of is None else np.bincount(of, minlength=len(x))
            square = (x**2).sum(1)
            here = np.arange(len(x))
            for n, centres in sets.items():
                label = distances(x, centres[None])[:, 0].argmin(1)
                count, cost, sums = about[n][:, 0], about[n][:, 1], about[n][:, 2:]
                mean = sums / np.maximum(count, 1)[:, None]
                # cost is around the set's centres; around the means it is less by n * |centre - mean|^2
                spread = cost - count * ((centres - mean) ** 2).sum(1)
                apart = np.maximum(square[:, None] - 2 * x @ mean.T + (mean**2).sum(1), 0)
                total = apart * count + spread  # summed squared distances to the rows of each cluster
                inside = total[here, label] / np.maximum(count[label] - 1, 1)
                other = np.where(count > 0, total / np.maximum(count, 1), np.inf)
                other[here, label] = np.inf
                outside = other.min(1)
                larger = np.maximum(inside, outside)
                fit = (count[label] > 1) & (larger > 0) & np.isfinite(outside)
                held[n] += float((np.divide(outside - inside, larger, out=np.zeros(len(x)), where=fit) * times).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.float64())], names=["name", "s"])

    found = table.select("x").mapInArrow(score, "name int, s double").groupBy("name").agg(F.sum("s").alias("s")).collect()
    return {r["name"]: r["s"] / about[r["name"]][:, 0].sum() for r in found if r["name"] in about}


class CentresModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Number of the nearest centre of a feature vector, ties to the smaller number."""

    centres = Param(Params._dummy(), "centres", "one list of numbers per cluster", TypeConverters.identity)
    inertia = Param(Params._dummy(), "inertia", "summed squared distances of the rows it was fitted on", TypeConverters.toFloat)

    @classmethod
    def of(cls, centres: np.ndarray, inertia: float, features: str = "features", prediction: str = "cluster") -> CentresModel:
        return cls()._set(centres=centres.tolist(), inertia=inertia, featuresCol=features, predictionCol=prediction)

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.getOrDefault("centres")]

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.getFeaturesCol()))
        options = []
        for i, centre in enumerate(self.getOrDefault("centres")):
            gaps = F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
            options.append(F.struct(F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b).alias("d"), F.lit(i).alias("c")))
        best = F.least(*options) if len(options) > 1 else options[0]
        return df.withColumn(self.getPredictionCol(), best["c"])


def named_sets(ks: Sequence[int], seeds: Sequence[int], starts: int) -> dict[int, tuple[int, int]]:
    """Name of each set -> (k, seed): all starts of all seeds of all ks."""
    return {i: pair for i, pair in enumerate((k, s) for k in ks for s in seeds for _ in range(starts))}
