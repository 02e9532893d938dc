"""Forests of unlimited size, grown from one binned table.

Features are cut once into at most 255 bins; a row becomes a number, a label, a part (a fold, a role, a band of the target)
and one byte per feature. Any number of forests is grown from that table side by side: a forest is a setting, a mask over
columns and a set of parts, so scenarios, caps and folds need no table of their own. Bootstrap weights are Poisson
draws by a hash of row number and tree, the same in every run.

Growth has two phases. While a node holds more than `local_rows` rows, it is split from histograms: each task adds up
(tree, node, feature, bin), Spark sums the bins and picks the best cut, and rows find their node by walking the small
top of the tree, so nothing is rewritten between levels. When all nodes are small, each row is sent once per tree to
its node, and one task grows everything below it. A table that is small as a whole (proven by its count) is sent
to the tasks instead, a few trees each. A table of many rows whose rows of bins repeat is added up per distinct row of bins and draw
first: such rows end in the same node, so trees grow from those sums as they do from rows. Trees stay in Spark as a table of pieces; scoring takes them in groups of
bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.operators.stages import _TableModel
from tabkit.session import written

BINS = 255
SMALL_BYTES = 64 << 20  # a binned table up to this size is sent to every task
GROUP_BYTES = 256 << 20  # trees that are sent to the tasks at a time
FEW_ROWS = 200_000  # tables up to this size are not looked through for equal rows
CELL_ROWS = 4  # so many rows of equal bins, on average, are worth a sum
CELLS = 40_000  # (row, column) pairs that are looked at together
BLOCK = 16_000  # (node, bin) pairs that are scored together
TIED_ROWS = 4_000_000  # (row, column) pairs of nearly equal cuts that are held at a time
PIECES = "forest int, tree int, node int, feature binary, cut binary, value binary, gain binary"
_KINDS = {"feature": "<i2", "cut": "u1", "value": "<f8", "gain": "<f4"}
#: chances of at most 0, 1, 2, ... draws of a row, times 2^53
_DRAWN = np.ceil(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]) * 2.0**53).astype("u8")


@dataclass(frozen=True)
class Growth:
    """One forest: how its trees grow, and which columns and parts of the table they see."""

    trees: int = 300
    depth: int = 30
    leaf: int = 2
    split: int = 2
    subset: str = "all"
    bootstrap: bool = True
    seed: int = 42
    columns: tuple[int, ...] | None = None
    parts: tuple[int, ...] | None = None

    def tried(self, columns: int) -> int:
        """Number of columns that a node may choose from."""
        if self.subset == "all":
            return columns
        if self.subset in ("sqrt", "log2", "onethird"):
            size = {"sqrt": math.sqrt(columns), "log2": math.log2(max(columns, 1)), "onethird": columns / 3}[self.subset]
            return max(1, min(columns, math.ceil(size)))
        return max(1, min(columns, math.ceil(float(self.subset) * columns)))


@dataclass(frozen=True)
class Binned:
    """no, y, part, bins (a byte per feature), stored; the borders between the bins of each feature."""

    table: DataFrame
    borders: list[np.ndarray]
    rows: int


# ---- bins


def borders_of(rows: DataFrame, x: Column, width: int) -> list[np.ndarray]:
    """Borders between the bins of each column: half-way between neighbouring values, or between quantiles of many values."""
    shares = [i / (BINS - 2) for i in range(1, BINS - 2)]
    ends = {f"{k}{i}": f for i in range(width) for k, f in (("a", F.min(x[i])), ("b", F.max(x[i])), ("n", F.count_if(~x[i].isin(0.0, 1.0))))}
    found = rows.agg(*[f.alias(n) for n, f in ends.items()]).first().asDict()
    wide = [i for i in range(width) if found[f"n{i}"]]  # a column of 0 and 1, as one-hot columns are, is known by its ends
    if wide:
        # the sketches of all tasks meet in one: a task per core makes them
        dealt = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
        found |= dealt.agg(*[F.percentile_approx(x[i], shares, 10_000).alias(f"p{i}") for i in wide]).first().asDict()
    out = []
    for i in range(width):
        values = np.unique([v for v in (found[f"a{i}"], *(found.get(f"p{i}") or []), found[f"b{i}"]) if v is not None])
        out.append((values[1:] + values[:-1]) / 2)
    return out


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def cut_up(x: np.ndarray, borders: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of borders below it."""
    return np.stack([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(borders)], 1).astype("u1")


def binned(rows: DataFrame, label: str, features: str = "features", part: Column | None = None, borders: list[np.ndarray] | None = None, fitted: Column | None = None) -> Binned:
    """The stored table that forests grow from. Borders come from the rows where `fitted` holds."""
    part = F.lit(0) if part is None else part
    narrow = rows.select(
        F.col(f"`{label}`").cast("double").alias("y"), part.cast("int").alias("part"), vector_to_array(F.col(features)).alias("x"),
        (F.lit(True) if fitted is None else fitted).alias("fitted"),
    )
    narrow = written(narrow.where("y IS NOT NULL").withColumn("no", F.monotonically_increasing_id()), "features")
    first = narrow.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to grow trees from")
    borders = borders_of(narrow.where("fitted"), F.col("x"), first[0]) if borders is None else borders

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = cut_up(matrix_of(batch.column("x"), len(borders)), borders)
            columns = [*[batch.column(c) for c in ("no", "y", "part")], pa.array([r.tobytes() for r in bins], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["no", "y", "part", "bins"])

    table = written(narrow.select("no", "y", "part", "x").mapInArrow(cut, "no long, y double, part int, bins binary"), "binned")
    return Binned(table, borders, table.count())


def as_arrays(batch: pa.RecordBatch | pa.Table, width: int) -> tuple[np.ndarray, ...]:
    held = np.frombuffer(b"".join(batch.column("bins").to_pylist()), "u1").reshape(-1, width)
    return tuple(batch.column(c).to_numpy() for c in ("no", "y", "part")) + (held,)


# ---- growing below one node


def drawn(no: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row: Poisson(1) by a hash of the row's number."""
    x = no.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) * 0xD1B54A32D192ED03 % 2**64)
    for turn in (30, 27):
        x = (x ^ (x >> np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)  # a chance, times 2^53
    times = np.zeros(len(x), "u1")
    for bound in _DRAWN[: np.searchsorted(_DRAWN, x.max(initial=0), "right")]:
        times += x >= bound
    return times.astype("f8")


def _best_cuts(key: np.ndarray, w: np.ndarray, s: np.ndarray, nodes: int, width: int, leaf: float) -> tuple[np.ndarray, np.ndarray]:
    """Per node: the largest S_l^2 / W_l + S_r^2 / W_r of all cuts of one feature, and the last bin of the left side.

    A row's `key` is node * width + bin.
    """
    if not len(key):
        return np.full(nodes, -np.inf), np.zeros(nodes, int)
    if width == 2 and nodes * width <= 4 * len(key):  # one cut
        (left, rest), (ls, rest_s) = np.bincount(key, w, 2 * nodes).reshape(nodes, 2).T, np.bincount(key, s, 2 * nodes).reshape(nodes, 2).T
        right, rs = (left + rest) - left, (ls + rest_s) - ls
        fit = (left >= leaf) & (right >= leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(fit, ls * ls / left + rs * rs / right, -np.inf), np.zeros(nodes, int)
    if nodes * width <= 4 * len(key):
        best, at = np.full(nodes, -np.inf), np.zeros(nodes, int)
        if width == 1:
            return best, at
        weight, sums = np.bincount(key, w, nodes * width).reshape(nodes, width), np.bincount(key, s, nodes * width).reshape(nodes, width)
        step = max(1, BLOCK // width)
        for i in range(0, nodes, step):  # blocks that stay in the processor's cache
            upto, sums_upto = weight[i : i + step].cumsum(1), sums[i : i + step].cumsum(1)
            left, right = upto[:, :-1], upto[:, -1:] - upto[:, :-1]
            ls, rs = sums_upto[:, :-1], sums_upto[:, -1:] - sums_upto[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = ls * ls / left + rs * rs / right
            score[(left < leaf) | (right < leaf)] = -np.inf
            at[i : i + step] = first = score.argmax(1)
            best[i : i + step] = score[np.arange(len(first)), first]
        return best, at
    # few rows per node: sort by (node, bin) and look at the places where the bin changes
    shift = max(1, int(len(key) - 1).bit_length())
    order = np.sort((key << shift) | np.arange(len(key)))
    row, key = order & ((1 << shift) - 1), order >> shift
    weight, sums = np.cumsum(w[row]), np.cumsum(s[row])
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))  # last row of each (node, bin)
    owner = key[last] // width
    weight, sums = weight[last], sums[last]
    final = np.append(owner[1:] != owner[:-1], True)  # last bin of each node
    ends = np.flatnonzero(final)
    group = np.cumsum(final) - final
    w0, s0 = np.append(0, weight[ends][:-1])[group], np.append(0, sums[ends][:-1])[group]
    left, right = weight - w0, weight[ends][group] - weight
    ls, rs = sums - s0, sums[ends][group] - sums
    fit = ~final & (left >= leaf) & (right >= leaf)
    score = np.divide(ls * ls, left, out=np.full(len(left), -np.inf), where=fit)
    score += np.divide(rs * rs, right, out=np.zeros(len(left)), where=fit)
    top = np.maximum.reduceat(score, np.append(0, ends[:-1] + 1)) if len(ends) else np.empty(0)
    best, at = np.full(nodes, -np.inf), np.zeros(nodes, int)
    best[owner[ends]] = top
    hit = np.flatnonzero((score == top[group]) & fit)[::-1]
    at[owner[hit]] = key[last[hit]] % width
    return best, at


def _bundles(bins: np.ndarray, columns: np.ndarray, widths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns of two bins of which a row has at most one in its upper bin, as one-hot columns are, and 1 + that one's place, or 0."""
    found: list[tuple[list[int], np.ndarray]] = []
    for f in columns[widths[columns] == 2]:
        upper = np.flatnonzero(bins[f])
        for members, code in found:
            if len(members) < 255 and not code[upper].any():
                break
        else:
            if len(found) == 4:
                continue
            members, code = [], np.zeros(bins.shape[1], "u1")
            found.append((members, code))
        members.append(f)
        code[upper] = len(members)
    return [(np.array(members), code) for members, code in found if len(members) > 2]


def _added(key: np.ndarray, w: np.ndarray, s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur, and their sums."""
    if size <= 4 * len(key):
        weight = np.bincount(key, w, size)
        at = np.flatnonzero(weight)
        return at, weight[at], np.bincount(key, s, size)[at]
    shift = max(1, int(len(key) - 1).bit_length())
    order = np.sort((key << shift) | np.arange(len(key)))
    row, key = order & ((1 << shift) - 1), order >> shift
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(w[row], first), np.add.reduceat(s[row], first)


def _best_of_bundles(near: np.ndarray, bins: np.ndarray, w: np.ndarray, s: np.ndarray, bundles: list[np.ndarray], codes: int,
                     totals: tuple[np.ndarray, np.ndarray, np.ndarray], best: np.ndarray, leaf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, columns and scores of the best cuts among bundled columns, where they may be the best of their node.

    One pass over a bundle adds up all its columns: what is not in a column's upper bin is the rest of the node. These sums
    are rounded otherwise than `_best_cuts` does it, so columns that come near a node's best are measured again by it,
    and trees are the same bit by bit as without bundles. `totals` are weight, sum and squares of each node.
    """
    weight, sums, squares = totals
    found = []
    for i, members in enumerate(bundles):
        width = len(members) + 1
        at, rw, rs = _added(near * width + bins[codes + i], w, s, len(weight) * width)
        node, place = np.divmod(at, width)
        lw = weight[node] - rw
        fit = (place > 0) & (rw >= leaf) & (lw >= leaf)
        node, rw, rs, lw = node[fit], rw[fit], rs[fit], lw[fit]
        found.append((node, members[place[fit] - 1], (sums[node] - rs) ** 2 / lw + rs * rs / rw))
    node, column, about = (np.concatenate(c) for c in zip(*found))
    top = best.copy()
    np.maximum.at(top, node, about)
    keep = np.flatnonzero(about >= top[node] - 1e-8 * squares[node])
    keep = keep[np.lexsort((column[keep], node[keep]))]
    node, column = node[keep], column[keep]
    if not len(node):
        return node, column, np.empty(0)
    # the rows of each node in their order
    asked = np.zeros(len(weight), bool)
    asked[node] = True
    rows = np.flatnonzero(asked[near])
    rows = rows[np.argsort(near[rows], kind="stable")]
    size = np.bincount(near[rows], minlength=len(weight))
    first, many = (np.cumsum(size) - size)[node], size[node]
    score = np.empty(len(node))
    for part in np.split(np.arange(len(node)), np.flatnonzero(np.diff(np.cumsum(many) // TIED_ROWS)) + 1):
        own = np.repeat(np.arange(len(part)), many[part])
        start = first[part] - (np.cumsum(many[part]) - many[part])
        row = rows[np.arange(len(own)) + start[own]]
        score[part] = _best_cuts(2 * own + bins[column[part][own], row], w[row], s[row], len(part), 2, leaf)[0]
    order = np.lexsort((column, -score, node))
    chosen = order[np.append(True, np.diff(node[order]) > 0)]
    return node[chosen], column[chosen], score[chosen]


def grow(bins: np.ndarray, w: np.ndarray, y: np.ndarray, g: Growth, widths: np.ndarray, rng: np.random.Generator, depth: int = 0) -> dict[str, np.ndarray]:
    """The tree below one node, level by level. Children of a node are neighbours; leaves have feature -1."""
    middle = float(np.average(y, weights=w))
    keep = w > 0
    w, y = w[keep], y[keep] - middle
    return grow_sums(np.ascontiguousarray(bins[keep].T), w, w * y, w * y * y, middle, g, widths, rng, depth)


def grow_sums(bins: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray, middle: float, g: Growth, widths: np.ndarray, rng: np.random.Generator, depth: int = 0) -> dict[str, np.ndarray]:
    """`grow` from weights and sums of y - middle and its square, for rows or for groups of rows with equal bins (columns x rows)."""
    columns = np.arange(len(widths)) if g.columns is None else np.array(g.columns)
    columns = columns[widths[columns] > 1]
    tried, node = g.tried(len(columns)), np.zeros(len(w), int)
    bundles, apart, codes = [], columns, len(widths)
    if tried == len(columns) and len(w) > CELLS // 2:
        held = _bundles(bins, columns, widths)
        bundles = [members for members, _ in held]
        if bundles:
            apart = columns[~np.isin(columns, np.concatenate(bundles))]
            bins = np.vstack([bins[:codes], *[code[None] for _, code in held]])
    parts: dict[str, list] = {k: [] for k in _KINDS}
    nodes = 1
    while True:
        weight, sums = np.bincount(node, w, nodes), np.bincount(node, s, nodes)
        base = np.divide(sums * sums, weight, out=np.zeros(nodes), where=weight > 0)
        squares = np.bincount(node, q, nodes)
        spread = squares - base
        best, feature, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, int)
        grows = depth < g.depth and len(columns) > 0
        open_ = (weight >= max(2 * g.leaf, g.split)) & (spread > 1e-12 * np.maximum(base, 1e-300)) & (spread > 1e-12) if grows else np.zeros(nodes, bool)
        if open_.any():
            chosen = None
            if tried < len(columns):
                rank = np.argsort(rng.random((nodes, len(columns))), axis=1)
                chosen = np.zeros((nodes, len(columns)), bool)
                np.put_along_axis(chosen, rank[:, :tried], True, 1)
            if open_.all():
                near, bl, wl, sl = node, bins, w, s
            else:
                live = np.flatnonzero(open_[node])
                near, bl, wl, sl = node[live], bins.take(live, 1), w[live], s[live]
            each = max(1, CELLS // max(len(near), 1))
            scaled: tuple = (0, None)  # near * width of the last width
            together = bool(bundles) and each == 1 and nodes <= 2 * len(near)
            looked = apart if together else columns
            for i in range(0, len(looked), each):
                some = looked[i : i + each]
                n, width = len(some), int(widths[some].max())
                if n == 1:
                    scaled = scaled if scaled[0] == width else (width, near * width)
                    key, weights, values = scaled[1] + bl[some[0]], wl, sl
                else:
                    key = ((near * (n * width) + (np.arange(n) * width)[:, None]) + bl[some]).ravel()
                    weights, values = np.tile(wl, n), np.tile(sl, n)
                if chosen is not None:
                    cell = np.flatnonzero(chosen[near, i : i + each].T.ravel())
                    key, weights, values = key[cell], weights[cell], values[cell]
                score, at = _best_cuts(key, weights, values, nodes * n, width, g.leaf)
                score, at = score.reshape(nodes, -1), at.reshape(nodes, -1)
                first = score.argmax(1)
                top = score[np.arange(nodes), first]
                better = top > best
                best[better], feature[better], cut[better] = top[better], some[first][better], at[np.arange(nodes), first][better]
            if together:
                place, column, score = _best_of_bundles(near, bl, wl, sl, bundles, codes, (weight, sums, squares), best, g.leaf)
                better = (score > best[place]) | ((score == best[place]) & (score > -np.inf) & (column < feature[place]))
                place = place[better]
                best[place], feature[place], cut[place] = score[better], column[better], 0
        gain = np.where(feature >= 0, best - base, 0.0)
        split = (feature >= 0) & (gain > 1e-12 * np.maximum(base, 1e-300))
        feature[~split], gain[~split] = -1, 0.0
        place = np.cumsum(split) - split
        for name, values in (("feature", feature), ("cut", cut),
                             ("value", np.divide(sums, weight, out=np.zeros(nodes), where=weight > 0) + middle), ("gain", gain)):
            parts[name].append(values)
        if not split.any():
            made = {k: np.concatenate(v).astype(_KINDS[k]) for k, v in parts.items()}
            return made | {"left": lefts(made["feature"])}
        rows = np.flatnonzero(split[node])
        if len(rows) < len(node):
            node, bins, w, s, q = node[rows], bins.take(rows, 1), w[rows], s[rows], q[rows]
        right = bins[feature[node], np.arange(len(node))] > cut[node]
        node = 2 * place[node] + right
        nodes = 2 * int(split.sum())
        depth += 1


def walk(tree: Mapping[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Node of a tree that each row ends in."""
    feature, cut, left = tree["feature"], tree["cut"], tree["left"]
    at = np.zeros(len(bins), int)
    live = np.arange(len(bins)) if len(feature) and feature[0] >= 0 else np.empty(0, int)
    while len(live):
        node = at[live]
        at[live] = left[node] + (bins[live, feature[node]] > cut[node])
        live = live[feature[at[live]] >= 0]
    return at


def lefts(feature: np.ndarray) -> np.ndarray:
    """Left child of each node, -1 for leaves: nodes are numbered level by level, children side by side."""
    inner = feature >= 0
    return np.where(inner, 2 * np.cumsum(inner) - 1, -1)


def _piece(forest: int, tree: int, node: int, made: Mapping[str, np.ndarray]) -> tuple:
    return (forest, tree, node, *[made[k].astype(t).tobytes() for k, t in _KINDS.items()])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["forest", "tree", "node", *_KINDS])


def read_piece(row) -> dict[str, np.ndarray]:
    made = {k: np.frombuffer(row[k], t) for k, t in _KINDS.items() if k in row}
    return made | {"left": lefts(made["feature"]).astype("i4")}


def _weights(g: Growth, no: np.ndarray, part: np.ndarray, tree: int) -> np.ndarray:
    w = drawn(no, g.seed, tree) if g.bootstrap else np.ones(len(no))
    return w if g.parts is None else w * np.isin(part, g.parts)


def _rng(g: Growth, tree: int, node: int = 0) -> np.random.Generator:
    return np.random.default_rng([g.seed, tree, node])


# ---- growing from a table


def grow_forests(data: Binned, forests: Sequence[Growth], local_rows: int = 1_000_000, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The pieces of all forests, stored. A small table goes to every task; a large one is split from histograms first."""
    small = data.rows * (len(data.borders) + 20) <= small_bytes
    cells = None if small and data.rows <= FEW_ROWS else cells_of(data)
    if cells is not None:
        return written(_from_cells(data, cells, forests, _grown_pieces(forests, cells, data), PIECES), "trees")
    if small:
        return written(_from_small(data, forests), "trees")
    return written(_from_large(data, forests, local_rows), "trees")


def _units(forests: Sequence[Growth]) -> list[tuple[int, int]]:
    return [(f, t) for f, g in enumerate(forests) for t in range(g.trees)]


def _dealt(spark, units: int, least: int = 1) -> DataFrame:
    tasks = max(1, min(-(-units // least), 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, units, 1, tasks)


def _from_small(data: Binned, forests: Sequence[Growth]) -> DataFrame:
    spark, widths = data.table.sparkSession, np.array([len(b) + 1 for b in data.borders])
    sent = spark.sparkContext.broadcast(as_arrays(data.table.toArrow(), len(widths)))
    units = _units(forests)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, y, part, bins = sent.value
        for batch in batches:
            for u in batch.column("id").to_pylist():
                f, t = units[u]
                w = _weights(forests[f], no, part, t)
                if w.any():
                    yield _pieces([_piece(f, t, 0, grow(bins, w, y, forests[f], widths, _rng(forests[f], t)))])

    return _dealt(spark, len(units)).mapInArrow(make, PIECES)


# ---- growing from the distinct rows of bins


@dataclass(frozen=True)
class Cells:
    """The distinct (part, bins) of a table as arrays, their rows, and sums of y - middle and its square over them."""

    bins: np.ndarray
    part: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    middle: float
    sent: Broadcast | None  # bins and part


def cells_of(data: Binned, most_bytes: int = SMALL_BYTES) -> Cells | None:
    """Rows with equal bins and part end in the same node of any tree: their cells, if these are few and small, else None."""
    width = len(data.borders)
    most = min(data.rows // CELL_ROWS, most_bytes // (width + 40))
    guess = data.table.agg(F.approx_count_distinct(F.struct("part", "bins")).alias("n"), F.avg("y").alias("y")).first()
    if guess["n"] > 1.2 * most:
        return None
    middle = float(guess["y"])
    y = F.col("y") - F.lit(middle)
    keys = written(data.table.groupBy("part", "bins").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")), "cells")
    if keys.count() > most:
        return None
    held = keys.toArrow().sort_by([("part", "ascending"), ("bins", "ascending")])
    part = _parts_of(held.column("part"))  # a missing part is no part of any forest
    bins = np.frombuffer(b"".join(held.column("bins").to_pylist()), "u1").reshape(-1, width)
    sent = keys.sparkSession.sparkContext.broadcast((bins, part))
    return Cells(bins, part, *[held.column(c).to_numpy().astype("f8") for c in "nsq"], middle, sent)


def _parts_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Parts as numbers, NaN where missing."""
    return np.asarray(pc.fill_null(column.cast(pa.float64()), math.nan))


def _keys(bins: np.ndarray, part: np.ndarray | None = None) -> list[bytes]:
    """A row's bins and part as one key; missing parts are alike."""
    if part is not None:
        part = np.where(np.isnan(part), math.inf, part)
        bins = np.hstack([bins, np.ascontiguousarray(part)[:, None].view("u1")])
    bins = np.ascontiguousarray(bins)
    whole, size = bins.tobytes(), bins.shape[1]
    return [whole[i : i + size] for i in range(0, len(whole), size)]


def _in_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """no, y, part and the cell of each row. Tasks look it up in the arrays that the trees grow from, so no join table is built on the driver."""
    sent = cells.sent

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for batch in batches:
            if place is None:
                place = {k: i for i, k in enumerate(_keys(*sent.value))}
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), "u1").reshape(-1, sent.value[0].shape[1])
            at = [place[k] for k in _keys(bins, _parts_of(batch.column("part")))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[batch.column(c) for c in ("no", "y", "part")]], names=["cell", "no", "y", "part"])

    return rows.select("no", "y", "part", "bins").mapInArrow(find, "cell int, no long, y double, part int")


def _from_cells(data: Binned, cells: Cells, forests: Sequence[Growth], make, schema: str) -> DataFrame:
    """`make` of all trees: called with an iterator of (units, weights, sums, squares), the last three over all cells.

    Rows are dealt out by cell and number, so that a cell of many rows has several tasks; there each draw of rows is
    added up cell by cell. Trees and forests of one seed share their draws. Sums meet again draw by draw.
    """
    spark, units = data.table.sparkSession, _units(forests)
    of_draw: dict[tuple[int, int], list[int]] = {}
    whole = []
    for u, (f, t) in enumerate(units):
        of_draw.setdefault((forests[f].seed, t), []).append(u) if forests[f].bootstrap else whole.append(u)
    draws, middle, size = list(of_draw), cells.middle, len(cells.n)
    out = None
    if whole:
        sums = spark.sparkContext.broadcast((cells.n, cells.s, cells.q))

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from make(([whole[i]], *sums.value) for batch in batches for i in batch.column("id").to_pylist())

        out = _dealt(spark, len(whole)).mapInArrow(at_once, schema)
    if not draws:
        return out
    tasks = 4 * spark.sparkContext.defaultParallelism

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, no, y = (batch.column(c).to_numpy() for c in ("cell", "no", "y"))
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            at, y = cell[first].astype("<i4").tobytes(), y - middle
            found = []
            for d, (seed, tree) in enumerate(draws):
                w = drawn(no, seed, tree)
                s = w * y
                found.append((d, at, *[np.add.reduceat(v, first).tobytes() for v in (w, s, s * y)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), [pa.int32()] + [pa.binary()] * 4)], names=["draw", "at", "w", "s", "q"])

    def by_draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums():
            now, held = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["draw"] != now:
                        if held is not None:
                            yield of_draw[draws[now]], *held
                        now, held = r["draw"], np.zeros((3, size))
                    at = np.frombuffer(r["at"], "<i4")
                    place = slice(at[0], at[-1] + 1) if at[-1] - at[0] + 1 == len(at) else at  # increasing, mostly without gaps
                    for own, k in zip(held, "wsq"):
                        own[place] += np.frombuffer(r[k], "<f8")
            if held is not None:
                yield of_draw[draws[now]], *held

        yield from make(sums())

    rows = _in_cells(data.table, cells).select("cell", "no", "y")
    rows = rows.repartitionByRange(tasks, "cell", "no").sortWithinPartitions("cell", "no")
    added = written(rows.mapInArrow(add, "draw int, at binary, w binary, s binary, q binary"), "draws")
    grown = added.repartitionByRange(min(len(draws), 2 * tasks), "draw").sortWithinPartitions("draw").mapInArrow(by_draw, schema)
    return grown if out is None else grown.unionByName(out)


def _masked(cells: Cells, forests: Sequence[Growth]) -> dict[tuple[int, ...], tuple]:
    """For masks that see few of the cells apart: their own cells, as bins, part, and which of them each cell is."""
    out = {}
    for columns in {g.columns for g in forests if g.columns is not None}:
        key = np.hstack([cells.bins[:, list(columns)], np.ascontiguousarray(cells.part)[:, None].view("u1")])
        _, first, of = np.unique(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
        if 2 * len(first) <= len(of):
            out[columns] = cells.bins[first], cells.part[first], of.ravel()
    return out


def _tree_of_cells(cells: tuple, g: Growth, widths: np.ndarray, f: int, t: int, w: np.ndarray, s: np.ndarray, q: np.ndarray) -> dict | None:
    bins, part, shift, masked = cells
    if g.columns in masked:
        bins, part, of = masked[g.columns]
        w, s, q = (np.bincount(of, v, len(part)) for v in (w, s, q))
    seen = (w > 0) & (np.isin(part, g.parts) if g.parts is not None else True)
    if not seen.any():
        return None
    w, s, q = w[seen], s[seen], q[seen]
    middle = float(s.sum() / w.sum())
    return grow_sums(np.ascontiguousarray(bins[seen].T), w, s - w * middle, q - 2 * middle * s + middle**2 * w, middle + shift, g, widths, _rng(g, t))


def _grown_pieces(forests: Sequence[Growth], cells: Cells, data: Binned):
    units, widths = _units(forests), np.array([len(b) + 1 for b in data.borders])
    sent, middle, masked = cells.sent, cells.middle, data.table.sparkSession.sparkContext.broadcast(_masked(cells, forests))

    def make(sums) -> Iterator[pa.RecordBatch]:
        for mine, w, s, q in sums:
            for u in mine:
                f, t = units[u]
                made = _tree_of_cells((*sent.value, middle, masked.value), forests[f], widths, f, t, w, s, q)
                if made is not None:
                    yield _pieces([_piece(f, t, 0, made)])

    return make


def _scored_cells(forests: Sequence[Growth], marks: Sequence[Sequence[int]], first: np.ndarray, parts: Sequence[int], cells: Cells, data: Binned):
    """Sums of the trees' values per cell of the asked parts and mark; the trees are not kept."""
    units, widths = _units(forests), np.array([len(b) + 1 for b in data.borders])
    sent, middle, masked = cells.sent, cells.middle, data.table.sparkSession.sparkContext.broadcast(_masked(cells, forests))

    def make(sums) -> Iterator[pa.RecordBatch]:
        asked = np.flatnonzero(np.isin(sent.value[1], parts))
        bins, held = sent.value[0][asked], {}
        for mine, w, s, q in sums:
            for u in mine:
                f, t = units[u]
                place = int(np.searchsorted(marks[f], t, "right"))
                made = _tree_of_cells((*sent.value, middle, masked.value), forests[f], widths, f, t, w, s, q) if place < len(marks[f]) else None
                if made is not None:
                    value, at = made["value"][walk(made, bins)], int(first[f]) + place
                    held[at] = held[at] + value if at in held else value
        for at, value in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked.astype("i4")), pa.array(np.full(len(asked), at, "i4")), pa.array(value)], names=["cell", "at", "s"])

    return make


def _from_large(data: Binned, forests: Sequence[Growth], local_rows: int, node_bytes: int = 256 << 20) -> DataFrame:
    """Split nodes of more than `local_rows` rows by histograms, then grow what is below the others in one task each."""
    spark, width = data.table.sparkSession, len(data.borders)
    widths = np.array([len(b) + 1 for b in data.borders])
    units = _units(forests)
    tops = {u: {k: np.array([-1 if k == "feature" else 0]).astype(t) for k, t in _KINDS.items()} for u in range(len(units))}
    open_ = [(u, 0) for u in tops]
    depth, ready = 0, []
    while open_:
        per_pass = max(1, node_bytes // (24 * int(widths.sum())))
        found = {}
        for i in range(0, len(open_), per_pass):
            found |= _split_from_histograms(data, forests, units, tops, open_[i : i + per_pass], widths)
        following = []
        for u, node in open_:
            g, top, best = forests[units[u][0]], tops[u], found.get((u, node))
            if best is None:  # no rows
                continue
            weight, sums, gain, f, cut, lw, ls = best
            top["value"][node] = sums / weight
            if depth == 0 and weight <= local_rows:
                ready.append((u, node))
                continue
            if f is None or gain <= 0 or depth >= g.depth:
                continue
            top["feature"][node], top["cut"][node], top["gain"][node] = f, cut, gain
            child = len(top["feature"])
            for k, kind in _KINDS.items():
                top[k] = np.append(top[k], np.array([-1, -1] if k == "feature" else [0, 0]).astype(kind))
            for at, (n, s) in ((child, (lw, ls)), (child + 1, (weight - lw, sums - ls))):
                top["value"][at] = s / n
                (following if n > local_rows else ready).append((u, at))
        open_, depth = following, depth + 1
    tops = {u: top | {"left": lefts(top["feature"])} for u, top in tops.items()}
    levels = {(u, n): _depth_of(tops[u], n) for u, n in ready}
    sent = spark.sparkContext.broadcast(({u: {k: t[k] for k in ("feature", "cut", "left")} for u, t in tops.items()}, levels))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, ready = sent.value
        goals = {u: np.array(sorted(n for v, n in ready if v == u), int) for u in tops}
        for batch in batches:
            no, y, part, bins = as_arrays(batch, width)
            for u, (f, t) in enumerate(units):
                w = _weights(forests[f], no, part, t)
                node = walk(tops[u], bins)
                rows = np.flatnonzero((w > 0) & np.isin(node, goals[u]))
                if len(rows):
                    taken = pa.array(rows)
                    columns = [pa.array(np.full(len(rows), u, "i4")), pa.array(node[rows].astype("i4")), pa.array(w[rows]), pa.array(y[rows]), batch.column("bins").take(taken)]
                    yield pa.RecordBatch.from_arrays(columns, names=["unit", "node", "w", "y", "bins"])

    def make(table: pa.Table) -> pa.Table:
        u, node = table.column("unit")[0].as_py(), table.column("node")[0].as_py()
        f, t = units[u]
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), "u1").reshape(-1, width)
        made = grow(bins, table.column("w").to_numpy(), table.column("y").to_numpy(), forests[f], widths, _rng(forests[f], t, node), sent.value[1][u, node])
        return pa.Table.from_batches([_pieces([_piece(f, t, node, made)])])

    rows = data.table.mapInArrow(deal, "unit int, node int, w double, y double, bins binary")
    below = rows.groupBy("unit", "node").applyInArrow(make, PIECES)
    heads = [_piece(*units[u], -1, top) for u, top in tops.items() if len(top["left"]) > 1]
    if not heads:
        return below
    return below.unionByName(spark.createDataFrame(_pieces(heads).to_pandas(), PIECES))


def _depth_of(top: Mapping[str, np.ndarray], node: int) -> int:
    depth = 0
    while node:
        node, depth = int(np.flatnonzero((top["left"] == node) | (top["left"] == node - 1))[-1]), depth + 1
    return depth


def _split_from_histograms(data: Binned, forests, units, tops, nodes: list[tuple[int, int]], widths: np.ndarray) -> dict:
    """(unit, node) -> (weight, sum, gain, feature, cut, left weight, left sum) of the best cut of each node."""
    width, slots = len(widths), {}
    for u, n in nodes:
        slots.setdefault(u, []).append(n)
    seen = {}
    for u, members in slots.items():
        g = forests[units[u][0]]
        columns = np.arange(width) if g.columns is None else np.array(g.columns)
        for n in members:
            order = _rng(g, units[u][1], n + 1).permutation(len(columns))[: g.tried(len(columns))]
            seen[u, n] = set(columns[order].tolist())
    sent = data.table.sparkSession.sparkContext.broadcast(({u: {k: tops[u][k] for k in ("feature", "cut")} | {"left": lefts(tops[u]["feature"])} for u in slots}, seen))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, seen = sent.value
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            no, y, part, bins = as_arrays(batch, width)
            for u, members in slots.items():
                w = _weights(forests[units[u][0]], no, part, units[u][1])
                at = walk(tops[u], bins)
                slot = np.full(len(tops[u]["left"]), -1)
                slot[members] = np.arange(len(members))
                place = slot[at]
                rows = np.flatnonzero((w > 0) & (place >= 0))
                if not len(rows):
                    continue
                for f in range(width):
                    if not any(f in seen[u, n] for n in members):
                        continue
                    key = place[rows] * int(widths[f]) + bins[rows, f]
                    size = len(members) * int(widths[f])
                    sums = np.stack([np.bincount(key, w[rows], size), np.bincount(key, w[rows] * y[rows], size)])
                    held[u, f] = held[u, f] + sums if (u, f) in held else sums
        for (u, f), sums in held.items():
            cell = np.flatnonzero(sums[0])
            node = np.array(slots[u])[cell // int(widths[f])]
            mine = np.array([f in seen[u, int(n)] for n in node], bool)
            cell, node = cell[mine], node[mine]
            columns = [np.full(len(cell), u, "i4"), node.astype("i4"), np.full(len(cell), f, "i4"), (cell % int(widths[f])).astype("i4"), sums[0][cell], sums[1][cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["unit", "node", "f", "bin", "w", "s"])

    cells = data.table.mapInArrow(add, "unit int, node int, f int, bin int, w double, s double")
    cells = cells.groupBy("unit", "node", "f", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    upto = Window.partitionBy("unit", "node", "f").orderBy("bin")
    whole = Window.partitionBy("unit", "node", "f")
    cuts = cells.select(
        "unit", "node", "f", "bin", F.sum("w").over(upto).alias("lw"), F.sum("s").over(upto).alias("ls"), F.sum("w").over(whole).alias("w"), F.sum("s").over(whole).alias("s"),
    )
    leaf = F.lit(0)
    by_leaf: dict[int, list[int]] = {}
    for u in slots:
        by_leaf.setdefault(forests[units[u][0]].leaf, []).append(u)
    for least, members in by_leaf.items():
        leaf = F.when(F.col("unit").isin(members), F.lit(least)).otherwise(leaf) if len(by_leaf) > 1 else F.lit(least)
    rw, rs = F.col("w") - F.col("lw"), F.col("s") - F.col("ls")
    gain = F.when((F.col("lw") >= leaf) & (rw >= leaf), F.col("ls") ** 2 / F.col("lw") + F.try_divide(rs**2, rw) - F.col("s") ** 2 / F.col("w"))
    best = F.max(F.struct(F.coalesce(gain, F.lit(-1.0)).alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), "lw", "ls", "w", "s")).alias("b")
    out = {}
    for r in cuts.groupBy("unit", "node").agg(best).collect():
        b = r["b"]
        out[r["unit"], r["node"]] = (b["w"], b["s"], b["gain"], -b["f"], -b["bin"], b["lw"], b["ls"])
    return out


# ---- scoring


def _sums(pieces: list[dict], bins: np.ndarray, marks: Mapping[int, Sequence[int]]) -> dict[int, np.ndarray]:
    """Per forest: summed values (rows x marks) of its trees below each mark; `pieces` are sorted by forest and tree, tops first."""
    out, top, owner = {}, None, None
    for p in pieces:
        key = (p["forest"], p["tree"])
        if key != owner:
            owner, top = key, None
        if p["node"] < 0:
            top = walk(p, bins)
            value = np.where(np.isin(top, p["below"]) if len(p["below"]) else np.zeros(len(top), bool), 0.0, p["value"][top]) if p["counts"] else None
            rows = slice(None)
        elif top is None:
            value, rows = p["value"][walk(p, bins)], slice(None)
        else:
            rows = np.flatnonzero(top == p["node"])
            value = p["value"][walk(p, bins[rows])]
        if value is None:
            continue
        kept = out.setdefault(p["forest"], np.zeros((len(bins), len(marks[p["forest"]]))))
        first = int(np.searchsorted(marks[p["forest"]], p["tree"], "right"))
        kept[rows, first:] += value[..., None]
    return out


def _groups(trees: DataFrame, most: int) -> Iterator[list[dict]]:
    """The pieces in groups of at most about `most` bytes, which reach the driver one group at a time; tops come with each."""
    about = trees.select("forest", "tree", "node", F.octet_length("value").alias("n")).orderBy("forest", "tree", "node").collect()
    below: dict[tuple, list[int]] = {}
    for r in about:
        if r["node"] >= 0:
            below.setdefault((r["forest"], r["tree"]), []).append(r["node"])
    groups, size = [[]], 0
    for r in about:
        if size + 2 * r["n"] > most and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append((r["forest"], r["tree"], r["node"]))
        size += 2 * r["n"]
    for group in groups:
        mine = set(group)
        owners = {(f, t) for f, t, _ in group}
        lo, hi = min(group)[:2], max(group)[:2]
        near = trees.where(F.struct("forest", "tree").between(F.struct(F.lit(lo[0]), F.lit(lo[1])), F.struct(F.lit(hi[0]), F.lit(hi[1]))))
        held = []
        for r in near.select("forest", "tree", "node", "feature", "cut", "value").toLocalIterator():
            key = (r["forest"], r["tree"], r["node"])
            if key in mine or (r["node"] < 0 and key[:2] in owners):
                made = read_piece(r.asDict()) | {"forest": key[0], "tree": key[1], "node": key[2]}
                if key[2] < 0:
                    made |= {"below": np.array(below.get(key[:2], []), int), "counts": key in mine}
                held.append(made)
        yield sorted(held, key=lambda p: (p["forest"], p["tree"], p["node"]))


def _scorer(sent, borders: list[np.ndarray], marks: Mapping[int, Sequence[int]]):
    """The share of the sent pieces in all means, row by row."""
    size = sum(map(len, marks.values()))

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = []
            for i in range(0, len(column), 20_000):
                part = column.slice(i, 20_000)
                bins = _bins_of(part, borders)
                at = slice(None)
                if len(bins):  # equal rows of bins are walked once
                    _, rows, again = np.unique(np.ascontiguousarray(bins).view(f"V{bins.shape[1]}").ravel(), return_index=True, return_inverse=True)
                    bins, at = (bins[rows], again) if 2 * len(rows) < len(bins) else (bins, at)
                sums = _sums(sent.value, bins, marks)
                found.append(np.hstack([sums.get(f, np.zeros((len(bins), len(marks[f])))) / np.array(marks[f]) for f in sorted(marks)])[at])
            values = np.concatenate(found) if found else np.empty((0, size))
            yield pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), size).cast(pa.list_(pa.float64()))

    return score


def with_forests(df: DataFrame, x: Column, trees: DataFrame, borders: list[np.ndarray], marks: Mapping[int, Sequence[int]], out: str, most: int = GROUP_BYTES) -> DataFrame:
    """Adds `out`: an array with the mean over the first m trees for each forest and each of its marks m, in order.

    `x` is an array of the features, or of their bins as bytes. Rows are read once per group of trees; between groups
    they are stored.
    """
    places = [(f, m) for f in sorted(marks) for m in marks[f]]
    if trees.agg(F.sum(2 * F.octet_length("value"))).first()[0] > most:
        found = _by_cells(df, x, trees, borders, marks, out)
        if found is not None:
            return found
    df = df.withColumn(out, F.array(*[F.lit(0.0)] * len(places)))
    groups = _groups(trees, most)
    held = next(groups, [])
    while held:
        sent = df.sparkSession.sparkContext.broadcast(held)
        add = F.arrow_udf(_scorer(sent, borders, marks), "array<double>")(x)
        df = df.withColumn(out, F.zip_with(out, add, lambda a, b: a + b))
        following = next(groups, [])
        if following:
            df = written(df, "scored")
        held = following
    return df


def _bins_of(column: pa.Array, borders: list[np.ndarray]) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, len(borders))
    return cut_up(matrix_of(column, len(borders)), borders)


def _binner(borders: list[np.ndarray]):
    def cut(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield column if pa.types.is_binary(column.type) else pa.array(_keys(_bins_of(column, borders)), pa.binary())

    return cut


def _looker(sent, borders: list[np.ndarray]):
    """The means of each row's cell."""

    def look(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = None
        for column in columns:
            if place is None:
                place = {k: i for i, k in enumerate(_keys(sent.value[0]))}
            at = [place[k] for k in _keys(_bins_of(column, borders))]
            means = sent.value[1][at]
            yield pa.FixedSizeListArray.from_arrays(pa.array(means.ravel()), means.shape[1]).cast(pa.list_(pa.float64()))

    return look


def _by_cells(df: DataFrame, x: Column, trees: DataFrame, borders: list[np.ndarray], marks: Mapping[int, Sequence[int]], out: str, most_bytes: int = SMALL_BYTES) -> DataFrame | None:
    """`with_forests` for trees of many bytes: if the distinct rows of bins are few, they are sent to the trees instead.

    None if they are many, or if trees lie in several pieces.
    """
    if trees.where("node <> 0").limit(1).count():
        return None
    spark, size = df.sparkSession, sum(map(len, marks.values()))
    most = most_bytes // (len(borders) + 8 * size)
    own = df.select(F.arrow_udf(_binner(borders), "binary")(x).alias("__bins")).distinct().limit(most + 1).toArrow().column("__bins").to_pylist()
    if len(own) > most:
        return None
    first = dict(zip(sorted(marks), np.cumsum([0, *[len(marks[f]) for f in sorted(marks)]]).tolist()))
    sent = spark.sparkContext.broadcast(np.frombuffer(b"".join(own), "u1").reshape(-1, len(borders)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                place = int(np.searchsorted(marks[r["forest"]], r["tree"], "right"))
                if place < len(marks[r["forest"]]):
                    made, at = read_piece(r), first[r["forest"]] + place
                    value = made["value"][walk(made, sent.value)]
                    held[at] = held[at] + value if at in held else value
        for at, value in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype="i4")), pa.array(np.full(len(value), at, "i4")), pa.array(value)], names=["cell", "at", "s"])

    pieces = trees.where(F.col("forest").isin(list(marks))).select("forest", "tree", "node", "feature", "cut", "value")
    sums = pieces.mapInArrow(add, "cell int, at int, s double").groupBy("cell", "at").agg(F.sum("s").alias("s"))
    held = sums.toArrow()
    by_mark = np.zeros((len(own), size))
    by_mark[held.column("cell").to_numpy(), held.column("at").to_numpy()] = held.column("s").to_numpy()
    means = [by_mark[:, first[f] : first[f] + len(marks[f])].cumsum(1) / np.array(marks[f]) for f in sorted(marks)]
    found = spark.sparkContext.broadcast((sent.value, np.hstack(means)))
    return df.withColumn(out, F.arrow_udf(_looker(found, borders), "array<double>")(x))


def held_out(data: Binned, forests: Sequence[Growth], marks: Sequence[Sequence[int]], parts: Sequence[int], small_bytes: int = SMALL_BYTES, local_rows: int = 1_000_000) -> DataFrame:
    """no, y, part and `means`, an array: the mean over the first m trees of every forest and mark, for the rows of some parts.

    Forests of a small table are scored where they grow, and their trees are not kept.
    """
    by = dict(enumerate(marks))
    own = data.table.where(F.col("part").isin(list(parts))).select("no", "y", "part", "bins")
    first = np.cumsum([0, *[len(m) for m in marks]])
    small = data.rows * (len(data.borders) + 20) <= small_bytes
    cells = None if small and data.rows <= FEW_ROWS else cells_of(data)
    if cells is None and not small:
        trees = written(_from_large(data, forests, local_rows), "trees")
        return with_forests(own, F.col("bins"), trees, data.borders, by, "means").drop("bins")
    if cells is not None:
        make = _scored_cells(forests, marks, first, list(parts), cells, data)
        sums = written(_from_cells(data, cells, forests, make, "cell int, at int, s double").groupBy("cell", "at").agg(F.sum("s").alias("s")), "sums")
        return _in_cells(own, cells).join(_means(sums, "cell", by, first), "cell").select("no", "y", "part", "means")
    spark, widths = data.table.sparkSession, np.array([len(b) + 1 for b in data.borders])
    sent = spark.sparkContext.broadcast(as_arrays(data.table.toArrow(), len(widths)))
    units = _units(forests)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, y, part, bins = sent.value
        asked = np.flatnonzero(np.isin(part, parts))
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for u in batch.column("id").to_pylist():
                f, t = units[u]
                w, place = _weights(forests[f], no, part, t), int(np.searchsorted(marks[f], t, "right"))
                if w.any() and place < len(marks[f]):
                    made = grow(bins, w, y, forests[f], widths, _rng(forests[f], t))
                    value = made["value"][walk(made, bins[asked])]
                    at = int(first[f]) + place
                    held[at] = held[at] + value if at in held else value
        for at, value in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(no[asked]), pa.array(np.full(len(asked), at, "i4")), pa.array(value)], names=["no", "at", "s"])

    # stored: whoever reads the scores more than once must not grow the trees again
    sums = written(_dealt(spark, len(units)).mapInArrow(make, "no long, at int, s double").groupBy("no", "at").agg(F.sum("s").alias("s")), "sums")
    return own.drop("bins").join(_means(sums, "no", by, first), "no").select("no", "y", "part", "means")


def _means(sums: DataFrame, key: str, by: Mapping[int, Sequence[int]], first: np.ndarray) -> DataFrame:
    """`means` of each key from the sums (`at`, `s`) of the trees between the marks of every forest."""
    sums = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "s"))).alias("s"))
    means = []
    for f, counts in by.items():
        for i, m in enumerate(counts):
            upto = [F.coalesce(F.try_element_at("s", F.lit(int(first[f]) + j)), F.lit(0.0)) for j in range(i + 1)]
            means.append(sum(upto[1:], upto[0]) / m)
    return sums.select(key, F.array(*means).alias("means"))


def importances(trees: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Per forest: each tree's gains by feature as shares of its sum, averaged over the trees."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                feature, gain = np.frombuffer(r["feature"], "<i2"), np.frombuffer(r["gain"], _KINDS["gain"]).astype("f8")
                sums = np.bincount(feature[feature >= 0], gain[feature >= 0], width).astype("f8")  # whole numbers if there is no split
                some = np.flatnonzero(sums)
                columns = [np.full(len(some), r["forest"], "i4"), np.full(len(some), r["tree"], "i4"), some.astype("i4"), sums[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["forest", "tree", "f", "gain"])

    gains = trees.select("forest", "tree", "feature", "gain").mapInArrow(add, "forest int, tree int, f int, gain double")
    gains = gains.groupBy("forest", "tree", "f").agg(F.sum("gain").alias("gain"))
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy("forest", "tree"))
    gains = gains.withColumn("share", share).groupBy("forest", "f").agg(F.sum("share").alias("share"))
    out: dict[int, np.ndarray] = {}
    for r in gains.collect():
        out.setdefault(r["forest"], np.zeros(width))[r["f"]] = r["share"]
    return {f: v / v.sum() for f, v in out.items()}


def tree_sizes(trees: DataFrame) -> DataFrame:
    """forest, tree, depth, nodes of every tree."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                left = lefts(np.frombuffer(r["feature"], _KINDS["feature"]))
                level, depths = np.array([0]), np.zeros(len(left), "i4")
                depth = 0
                while len(level):
                    depths[level] = depth
                    inner = level[left[level] >= 0]
                    level, depth = np.concatenate([left[inner], left[inner] + 1]), depth + 1
                found += [(r["forest"], r["tree"], r["node"], n, int(d)) for n, d in ([(-1, depths.max())] if r["node"] >= 0 else enumerate(depths))]
                found += [(r["forest"], r["tree"], r["node"], -2, len(left))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*found)], names=["forest", "tree", "node", "at", "n"])

    found = trees.select("forest", "tree", "node", "feature").mapInArrow(measure, "forest int, tree int, node int, at int, n int")
    own = found.where("node >= 0 AND at = -1").select("forest", "tree", "node", "n")
    tops = found.where("node < 0 AND at >= 0").select("forest", "tree", F.col("at").alias("node"), F.col("n").alias("above"))
    deep = own.join(tops, ["forest", "tree", "node"], "full").groupBy("forest", "tree").agg(F.max(F.coalesce("n", F.lit(0)) + F.coalesce("above", F.lit(0))).alias("depth"))
    # a piece's root is a node of the top already
    nodes = found.where("at = -2").groupBy("forest", "tree").agg((F.sum("n") - F.when(F.min("node") < 0, F.count_if(F.col("node") >= 0)).otherwise(0)).cast("int").alias("nodes"))
    return deep.join(nodes, ["forest", "tree"])


# ---- stages


class _Forest(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most levels below the root", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt)
    leastSplit = Param(Params._dummy(), "leastSplit", "least rows of a node that is split", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "columns tried per node", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows with replacement", TypeConverters.toBoolean)
    borders = Param(Params._dummy(), "borders", "borders between the bins of each column", TypeConverters.identity)
    gains = Param(Params._dummy(), "gains", "importance of each column", TypeConverters.toListFloat)

    def growth(self) -> Growth:
        get = self.getOrDefault
        return Growth(get("numTrees"), get("maxDepth"), get("minInstancesPerNode"), get("leastSplit"), get("featureSubsetStrategy"), get("bootstrap"), self.getSeed())


class ForestRegressor(Estimator, _Forest, DefaultParamsReadable, DefaultParamsWritable):
    """Random forest regression on a feature vector; the mean of its trees, which may be as deep as their rows allow."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=300, maxDepth=30,
                 minInstancesPerNode=2, leastSplit=2, featureSubsetStrategy="all", bootstrap=True, seed=42):
        super().__init__()
        self._setDefault(numTrees=300, maxDepth=30, minInstancesPerNode=2, leastSplit=2, featureSubsetStrategy="all", bootstrap=True, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ForestModel:
        data = binned(df, self.getLabelCol(), self.getFeaturesCol())
        return self.model_of(grow_forests(data, [self.growth()]), data.borders, 0)

    def model_of(self, trees: DataFrame, borders: list[np.ndarray], forest: int, gains: np.ndarray | None = None) -> ForestModel:
        """The model of one of several forests that were grown side by side."""
        own = trees.where(F.col("forest") == forest)
        model = self._copyValues(ForestModel())
        gains = importances(own, len(borders)).get(forest, np.zeros(len(borders))) if gains is None else gains
        model._set(borders=[b.tolist() for b in borders], gains=[float(v) for v in gains])
        model.table = own.withColumn("forest", F.lit(0))
        return model


class ForestModel(_TableModel, _Forest):
    """A fitted forest; `table` holds the pieces of its trees."""

    def _hold(self, table: DataFrame) -> ForestModel:
        self.table = table  # trees are never joined to rows, so their size is not looked at
        return self

    @property
    def featureImportances(self):
        return Vectors.dense(self.getOrDefault("gains"))

    def sizes(self) -> DataFrame:
        return tree_sizes(self.table).drop("forest")

    def _transform(self, df: DataFrame) -> DataFrame:
        borders = [np.array(b) for b in self.getOrDefault("borders")]
        x = vector_to_array(F.col(self.getFeaturesCol()))
        scored = with_forests(df, x, self.table, borders, {0: [self.getOrDefault("numTrees")]}, "__means")
        return scored.withColumn(self.getPredictionCol(), F.col("__means")[0]).drop("__means")
