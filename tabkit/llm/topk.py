"""Exact top-k by integer inner product: branch and bound over a vertical layout.

Candidates are read once per block of queries and turned into columns (dimensions x rows). Products are
accumulated block of dimensions by block. After each block, a candidate whose product so far plus the largest
possible rest (product of the norms of the dimensions not yet seen) stays below the query's k-th best score is
dropped, and the surviving columns are compacted. The k-th best score starts from a few candidates read first
and rises while a task reads on.

A block of queries has at most `query_block` rows, so what is broadcast is bounded; blocks of queries follow
one another. Tasks return at most k rows per query, merged by one window per query.

Defined results: vectors that are null, or hold null or non-finite components, take no part, neither do rows
without an id; only vectors of equal length are compared; an empty vector scores 0; equal scores rank by id; rows
with the query's id are no candidates, other repeated ids stay separate rows; query rows with one id have a list each;
an empty table gives no rows; other columns are ignored. Products that could exceed 2^53 are summed in 64-bit integers;
vectors whose products could leave those stop the query with an error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.session import scratch_path, written

FOUND = "query long, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def as_integers(vector: Column, scale: float) -> Column:
    """Components times `scale`, rounded down; one beyond 2^53 stops the query."""
    made = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    fit = F.when(~F.exists(made, lambda x: F.abs(x) > F.lit(2.0**53)), F.transform(made, lambda x: x.cast("long")))
    return F.coalesce(fit, F.when(vector.isNotNull(), F.raise_error(F.lit("a component exceeds 2^53")).cast("array<long>")))


def matrix(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and (rows x length) matrix for each vector length in a batch; the vectors hold no nulls."""
    values = batch.column(column)
    starts = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(starts)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)].reshape(len(rows), n)


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, step: int, floor: np.ndarray | None = None):
        self.ids, self.k, self.step = ids, k, step
        self.top = np.abs(vectors).max(initial=0)
        self.vectors = vectors
        edges = range(0, vectors.shape[1], step) or [0]
        square = np.array([(vectors[:, i:].astype("f8") ** 2).sum(1) for i in edges] + [np.zeros(len(ids))])
        self.rest = np.sqrt(square)
        self.scores = [np.empty(0, "i8")] * len(ids)
        self.found = [np.empty(0, "i8")] * len(ids)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Look through candidates: rows x dimensions."""
        n = rows.shape[1]
        largest = float(self.top) * float(np.abs(rows).max(initial=0)) * max(n, 1)
        if largest >= 2**63:
            raise ValueError("products of these vectors exceed 64-bit integers")
        exact = largest < 2**53
        kind = "f8" if exact else "i8"
        columns, asked = np.ascontiguousarray(rows.T.astype(kind)), self.vectors.astype(kind)
        edges = list(range(0, n, self.step)) or [0]
        square = np.array([(columns[i:].astype("f8") ** 2).sum(0) for i in edges] + [np.zeros(len(ids))])
        rest = np.sqrt(square)
        first = asked[:, : self.step] @ columns[: self.step]
        slack = 1 + 1e-9  # the bound is rounded; the products are not
        for q in range(len(self.ids)):
            part, live = first[q], None
            for b, at in enumerate(edges):
                if b:
                    part = part + asked[q, at : at + self.step] @ columns[at : at + self.step, live]
                bound = part + self.rest[b + 1][q] * (rest[b + 1] if live is None else rest[b + 1][live]) * slack
                keep = np.flatnonzero(bound >= self.floor[q] - 1e-6)
                part, live = part[keep], keep if live is None else live[keep]
                if not len(live):
                    break
            if len(live):
                live, part = live[(own := ids[live] != self.ids[q])], part[own]
                self._merge(q, ids[live], part.astype("i8"))

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.found[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.scores[q][-1])


def _by_length(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    held: dict[int, list] = {}
    for row in rows:
        held.setdefault(len(row[1]), []).append(row)
    return {
        n: (np.array([r[0] for r in m], "i8"), np.array([r[1] for r in m], "i8").reshape(len(m), n)) for n, m in held.items()
    }


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_: str = "vec_id",
    vector: str = "embedding",
    scale: float = 1024.0,
    query_block: int = 4096,
    dims: int = 16,
    seed_rows: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query row among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(id_).cast("long").alias("id"), as_integers(F.col(vector), scale).alias("v"), is_query.alias("q"))
    asked = written(rows.where("q").select("id", "v"), "queries")
    n = asked.count()
    blocks = -(-n // query_block)
    part = F.lit(1)
    if blocks > 1:  # about equal shares by id, without one task that sees all queries
        cuts = asked.select(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 10_000)).first()[0]
        part = sum((F.col("id") > F.lit(c)).cast("int") for c in cuts) + 1
    seeds = _by_length((r["id"], r["v"]) for r in rows.select("id", "v").limit(seed_rows).collect())

    path = scratch_path(spark, "top-rows")
    for b in range(1, max(blocks, 1) + 1):  # the best rows for each block are written before the next block is read
        ready = {}
        for size, (ids, values) in _by_length((r["id"], r["v"]) for r in asked.where(part == b).collect()).items():
            best = _Best(ids, values, k, dims)
            if size in seeds:
                best.add(*seeds[size])
            ready[size] = (ids, values, best.floor)
        sent = spark.sparkContext.broadcast(ready)

        def search(batches: Iterator[pa.RecordBatch], sent=sent, b=b) -> Iterator[pa.RecordBatch]:
            best = {size: _Best(i, v, k, dims, f.copy()) for size, (i, v, f) in sent.value.items()}
            for batch in batches:
                ids = batch.column("id").to_numpy()
                for at, m in matrix(batch, "v"):
                    if m.shape[1] in best:
                        for i in range(0, len(at), 8192):
                            best[m.shape[1]].add(ids[at[i : i + 8192]], m[i : i + 8192])
            for length, x in best.items():
                size = [len(f) for f in x.found]
                if sum(size):
                    # queries are numbered by block, length and place, so that repeated ids stay apart
                    number = (b << 44) + (length << 20) + np.arange(len(x.ids))
                    columns = np.repeat(number, size), np.repeat(x.ids, size), np.concatenate(x.found), np.concatenate(x.scores)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "score"])

        rows.select("id", "v").mapInArrow(search, FOUND).write.mode("append").parquet(path)
    found = spark.read.parquet(path)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
