"""Hard negatives by rotated one-bit codes with certain bounds.

Every vector is rotated (sign flips and fast Hadamard transforms) and replaced by the signs of its components, one bit
each; the alignment of the vector with its code, a dot product, is stored beside it. What the code leaves over is
rotated and coded again, `levels` times in all, and the norm of the last rest is stored. An anchor's rotated components
are rounded to `bits` bits, so its product with a code is a weighted sum of popcounts. By Cauchy-Schwarz the true product
lies within (anchor's norm x row's rest) + (anchor's rounding error x alignments) of that estimate. Only rows whose
interval can still enter a result are scored, by integer products; what is returned is exact.

Codes are made once and written. Anchors are taken in blocks of about `anchor_block`, one after the other: a block is broadcast,
all rows are searched, and the best rows of each task are written. The first pass finds the positives, the second the
negatives below each of them.

Defined results: rows with a null label, a null vector or null or non-finite components take no part, neither do rows
without an id; an empty vector scores 0; only vectors of equal length are compared; a row is never its own
positive, but other rows with its id are rows like all others, and repeated rows count each; ties go to the smaller id,
then to any of the equal ids; an anchor without positives, or a positive without negatives, gives no rows; so does an
empty table; other columns are ignored. A vector whose products could leave the range of 64-bit integers stops the query
with an error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.embed_dedup import hadamard
from tabkit.llm.topk import as_integers, matrix, usable
from tabkit.session import scratch_path, written

CODED = "no long, id long, label string, v array<long>, codes binary, along array<double>, rest double"
FOUND = "anchor long, positive long, no long, id long, score long"


def rotate(x: np.ndarray, level: int) -> np.ndarray:
    """Rows turned by the level's rotation; their length is a power of two."""
    n = x.shape[1]
    rng = np.random.default_rng([11, level, n])
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), n)) / np.sqrt(n)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    n = 1 << max(6, int(x.shape[1] - 1).bit_length())
    return np.pad(x.astype("f8"), ((0, 0), (0, n - x.shape[1])))


def words(positive: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(positive, axis=1).view("u8")


def encode(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x levels x words), alignments (rows x levels) and the norm of the rest, rounded up."""
    rest, codes, along = padded(x), [], []
    for level in range(levels):
        rest = rotate(rest, level)
        sign = np.where(rest > 0, 1.0, -1.0) / np.sqrt(rest.shape[1])
        codes.append(words(rest > 0))
        along.append((rest * sign).sum(1))
        rest = rest - along[-1][:, None] * sign
    size = np.sqrt((padded(x) ** 2).sum(1))
    return np.stack(codes, 1), np.stack(along, 1), np.sqrt((rest**2).sum(1)) + 1e-9 * size


class Asked:
    """Anchors of one length, their rotated components cut into bit planes."""

    def __init__(self, no: np.ndarray, labels: np.ndarray, x: np.ndarray, levels: int, bits: int):
        self.no, self.labels, self.x = no, labels, x
        turned = padded(x)
        self.norm = np.sqrt((turned**2).sum(1)) * (1 + 1e-12)
        self.low, self.step, self.total, self.error, self.planes = [], [], [], [], []
        for level in range(levels):
            turned = rotate(turned, level)
            low = turned.min(1, keepdims=True)
            step = np.maximum((turned.max(1, keepdims=True) - low) / (2**bits - 1), 1e-300)
            units = np.rint((turned - low) / step)
            near = low + step * units
            self.low.append(low)
            self.step.append(step)
            self.total.append(near.sum(1, keepdims=True))
            self.error.append(np.sqrt(((turned - near) ** 2).sum(1)) + 1e-9 * self.norm)
            self.planes.append([words((units.astype("i8") >> b & 1) > 0) for b in range(bits)])

    def estimate(self, a: int, b: int, codes: np.ndarray, along: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated products of anchors a to b with coded rows, and how far they can be off."""
        size = 64 * codes.shape[2]
        found = np.zeros((b - a, len(codes)))
        off = self.norm[a:b, None] * rest
        for level, planes in enumerate(self.planes):
            code = codes[:, level]
            ones = np.bitwise_count(code).sum(1, dtype="f8")
            units = np.zeros_like(found)
            for bit, plane in enumerate(planes):
                for w in range(code.shape[1]):
                    units += np.bitwise_count(plane[a:b, w, None] & code[:, w]) * float(1 << bit)
            sums = 2 * (self.low[level][a:b] * ones + self.step[level][a:b] * units) - self.total[level][a:b]
            found += sums / np.sqrt(size) * along[:, level]
            off += self.error[level][a:b, None] * along[:, level]
        return found, off


def _fits(x: np.ndarray, y: np.ndarray) -> str:
    """The number type that holds the products of rows of x and y exactly."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(x.shape[1], 1)
    if top >= 2**63:
        raise ValueError("products of these vectors exceed 64-bit integers")
    return "f8" if top < 2**53 else "i8"


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class Positives:
    """The k best rows of each anchor's label so far."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, k
        self.held = [(np.empty(0, "i8"),) * 3] * len(asked.no)
        self.floor = np.full(len(asked.no), -np.inf)

    def wanted(self, a: int, b: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (high >= self.floor[a:b, None]) & (self.asked.labels[a:b, None] == labels)

    def add(self, q: int, no: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        other = no != self.asked.no[q]
        joined = [np.concatenate([old, new[other]]) for old, new in zip(self.held[q], (score, ids, no))]
        order = _best(joined[0], joined[1], self.k)
        self.held[q] = tuple(c[order] for c in joined)
        if len(order) == self.k:
            self.floor[q] = self.held[q][0][-1]

    def rows(self) -> Iterator[tuple]:
        for q, (score, ids, no) in enumerate(self.held):
            yield from zip([self.asked.no[q]] * len(no), [None] * len(no), no, ids, score)


class Negatives:
    """The k best rows of other labels below each of an anchor's positives so far."""

    def __init__(self, asked: Asked, k: int, positives: list[list[tuple[int, int]]], share: int):
        self.asked, self.k, self.positives, self.share = asked, k, positives, share
        self.held = [[(np.empty(0, "i8"),) * 3] * len(p) for p in positives]
        self.floor = np.array([min((-(-share * s // 100) for _, s in p if s >= 0), default=np.inf) for p in positives], "f8")
        self.top = np.array([max((s for _, s in p), default=-np.inf) for p in positives], "f8")

    def wanted(self, a: int, b: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        open_ = (high >= self.floor[a:b, None]) & (low <= self.top[a:b, None])
        return open_ & (self.asked.labels[a:b, None] != labels)

    def add(self, q: int, no: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        lowest = np.inf
        for p, (_, above) in enumerate(self.positives[q]):
            least = -(-self.share * above // 100)
            fit = (score >= least) & (score <= above)
            if fit.any():
                joined = [np.concatenate([old, new[fit]]) for old, new in zip(self.held[q][p], (score, ids, no))]
                order = _best(joined[0], joined[1], self.k)
                self.held[q][p] = tuple(c[order] for c in joined)
            if above >= 0:
                full = len(self.held[q][p][0]) == self.k
                lowest = min(lowest, self.held[q][p][0][-1] if full else least)
        self.floor[q] = lowest

    def rows(self) -> Iterator[tuple]:
        for q, parts in enumerate(self.held):
            for (positive, _), (score, ids, no) in zip(self.positives[q], parts):
                yield from zip([self.asked.no[q]] * len(no), [positive] * len(no), no, ids, score)


def coded(rows: DataFrame, levels: int) -> DataFrame:
    """Adds codes, alignments and rests to rows of no, id, label, v."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrix(batch, "v"):
                codes, along, rest = encode(x, levels)
                own = batch.take(pa.array(at))
                extra = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(along), pa.list_(pa.float64())), pa.array(rest)]
                yield pa.RecordBatch.from_arrays([*own.columns, *extra], names=CODED.replace(",", "").split()[::2])

    return rows.mapInArrow(code, CODED)


def _searched(table: DataFrame, finders: dict, names: dict[str, int]) -> DataFrame:
    """The best rows of each task, for finders by vector length, which are broadcast."""
    sent = table.sparkSession.sparkContext.broadcast((finders, names))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders, names = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                for at, x in matrix(part, "v"):
                    if x.shape[1] not in finders:
                        continue
                    find, own = finders[x.shape[1]], part.take(pa.array(at))
                    asked = find.asked
                    kind = _fits(asked.x, x)
                    no, ids = own.column("no").to_numpy(), own.column("id").to_numpy()
                    labels = np.array([names.get(v, -1) for v in own.column("label").to_pylist()])
                    along = np.array(own.column("along").to_pylist()).reshape(len(at), -1)
                    codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), "u8").reshape(*along.shape, -1)
                    rest, rows, questions = own.column("rest").to_numpy(), x.astype(kind), asked.x.astype(kind)
                    for a in range(0, len(asked.no), 64):
                        b = min(a + 64, len(asked.no))
                        near, off = asked.estimate(a, b, codes, along, rest)
                        off = off * (1 + 1e-9) + 1e-6
                        live = find.wanted(a, b, labels, near - off, near + off)
                        for q in np.flatnonzero(live.any(1)):
                            few = np.flatnonzero(live[q])
                            find.add(a + q, no[few], ids[few], (rows[few] @ questions[a + q]).astype("i8"))
        for find in finders.values():
            rows = list(find.rows())
            for i in range(0, len(rows), 50_000):
                columns = zip(*rows[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "positive", "no", "id", "score"])

    return table.mapInArrow(search, FOUND)


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "no")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    share: int = 80,
    levels: int = 4,
    bits: int = 6,
    anchor_block: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each of an anchor's `positives` best other rows of its label: the `negatives` best rows of other labels that
    score from `share` percent of the positive's score up to all of it.
    """
    label = F.col(label) if isinstance(label, str) else label
    good = usable(F.col(vector)) & label.isNotNull() & F.col(id_).isNotNull()
    values = as_integers(F.col(vector), scale)
    rows = vectors.where(good).select(F.col(id_).cast("long").alias("id"), label.cast("string").alias("label"), values.alias("v"), is_anchor.alias("q"))
    numbered = written(rows.withColumn("no", F.monotonically_increasing_id()), "numbered")
    table = written(coded(numbered.select("no", "id", "label", "v"), levels), "codes")
    anchors = numbered.where("q")
    blocks = -(-anchors.count() // anchor_block)
    spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession, "hard-negatives")
    block = F.pmod(F.xxhash64("no"), F.lit(max(1, blocks)))
    for b in range(max(1, blocks)):
        held: dict[int, list] = {}
        for r in anchors.where(block == b).select("no", "id", "label", "v").collect():
            held.setdefault(len(r["v"]), []).append(r)
        names = {v: i for i, v in enumerate(sorted({r["label"] for m in held.values() for r in m}))}
        asked = {
            n: Asked(np.array([r["no"] for r in m]), np.array([names[r["label"]] for r in m]),
                     np.array([r["v"] for r in m], "i8").reshape(len(m), n), levels, bits)
            for n, m in held.items()
        }
        near = _first(_searched(table, {n: Positives(q, positives) for n, q in asked.items()}, names), positives, "anchor")
        near = written(near.select("anchor", F.col("no").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        above: dict[int, list] = {}
        for r in near.collect():
            above.setdefault(r["anchor"], []).append((r["positive"], r["positive_score"]))
        finders = {n: Negatives(q, negatives, [above.get(int(i), []) for i in q.no], share) for n, q in asked.items()}
        below = written(_first(_searched(table, finders, names), negatives, "anchor", "positive").drop("no"), "negatives")
        named = spark.createDataFrame([(r["no"], r["id"]) for m in held.values() for r in m], "anchor long, anchor_id long")
        full = below.join(F.broadcast(near), ["anchor", "positive"]).join(F.broadcast(named), "anchor")
        full = full.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        full.write.mode("append").parquet(path)
    return spark.read.parquet(path)
