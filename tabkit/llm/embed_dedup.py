"""Near-duplicate vectors by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of random sign flips and fast Hadamard transforms; the
axis it lies closest to, with its sign, is one hash. `hashes` of them make a bucket, in each of `tables` tables.
Multiprobe: the vector also goes to the buckets in which one hash is replaced by its second-nearest axis, for the
`probes` hashes whose two axes lie closest together. Vectors that share a bucket and a label are compared by cosine in
double precision, so what is linked is exact; what may be missed is measured against brute force in the tests.

Equal vectors of a label are one class from the start. Buckets larger than `block` classes are cut into blocks that
meet pairwise in different tasks. A task multiplies blocks and returns, per class, the number of its links, and
for each connected group only links to its smallest member; pairs are never listed. A pair that shares several
buckets counts in the smallest one.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and rows with a null
label, link with nothing; a null id is kept but never found by others; vectors of different length are never
compared; rows with equal ids stay apart as links, and share their component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import components, in_blocks, local_roots, runs
from tabkit.llm.topk import matrix, usable
from tabkit.session import written


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 3) -> np.ndarray:
    """(rows x tables * (1 + probes)) bucket codes; the table's number is part of each."""
    n = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng([seed, n])
    rows, found = np.arange(len(x)), []
    for t in range(tables):
        near, second, gap = [], [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), n)) / np.sqrt(n)
            size = np.abs(y)
            best = size.argmax(1)
            top = size[rows, best]
            near.append(best * 2 + (y[rows, best] > 0))
            size[rows, best] = -1
            other = size.argmax(1)
            second.append(other * 2 + (y[rows, other] > 0))
            gap.append(top - size[rows, other])
        near, second = np.stack(near, 1), np.stack(second, 1)
        order = np.argsort(np.stack(gap, 1), axis=1, kind="stable")
        place = (2 * n) ** np.arange(hashes, dtype="i8")
        main = near @ place
        found.append(main)
        for p in range(probes):
            at = order[:, p]
            found.append(main + (second[rows, at] - near[rows, at]) * place[at])
        for i in range(1 + probes):
            found[-1 - i] = found[-1 - i] * tables + t
    return np.stack(found, 1).astype("i8")


def coded(rows: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """id, label, print, unit (the vector as bytes of doubles, length 1), codes. The input has usable vectors only."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at, m in matrix(batch, "v"):
                m = m.astype("f8") + 0.0  # no negative zero
                top = np.abs(m).max(1, initial=0)
                at, m, top = at[top > 0], m[top > 0], top[top > 0]
                if not len(at):
                    continue
                unit = m / top[:, None]
                unit /= np.sqrt((unit**2).sum(1))[:, None]
                codes = bucket_codes(unit, tables, hashes, probes)
                prints = [xxhash.xxh3_128_digest(r.tobytes()) for r in m]
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(own), batch.column("label").take(own), pa.array(prints, pa.binary()),
                     pa.array([r.tobytes() for r in unit], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                    names=["id", "label", "print", "unit", "codes"],
                )

    return rows.mapInArrow(code, "id long, label string, print binary, unit binary, codes array<long>")


def _first_shared(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest code that rows i and j share, pair by pair."""
    found = np.full(len(i), np.iinfo("i8").max)
    for a in range(codes.shape[1]):
        same = (codes[j] == codes[i, a][:, None]).any(1)
        found[same] = np.minimum(found[same], codes[i[same], a])
    return found


def _linked(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links per row, and pairs of rows that connect what is linked, within one group of blocks."""
    rows = table.num_rows
    unit = np.stack([np.frombuffer(x, "f8") for x in table.column("unit").to_pylist()])
    codes = np.array(table.column("codes").to_pylist(), "i8")
    code, side, size = table.column("code")[0].as_py(), table.column("side").to_numpy(), table.column("n").to_numpy()
    crossing = len(np.unique(side)) > 1  # two blocks meet: pairs within a block belong to that block's own group
    links, left, right = np.zeros(rows, "i8"), [], []
    for at in range(0, rows, 512):
        close = unit[at : at + 512] @ unit.T >= least
        i, j = np.nonzero(close)
        i = i + at
        own = i < j if not crossing else (i < j) & (side[i] != side[j])
        i, j = i[own], j[own]
        for k in range(0, len(i), 200_000):
            p, q = i[k : k + 200_000], j[k : k + 200_000]
            mine = _first_shared(codes, p, q) == code
            np.add.at(links, p[mine], size[q[mine]])
            np.add.at(links, q[mine], size[p[mine]])
            root = local_roots(rows, p, q)
            changed = np.flatnonzero(root != np.arange(rows))
            left.append(changed)
            right.append(root[changed])
    return links, np.concatenate([*left, np.empty(0, "i8")]), np.concatenate([*right, np.empty(0, "i8")])


def near_vectors(
    vectors: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    tables: int = 6,
    hashes: int = 3,
    probes: int = 2,
    block: int = 2048,
) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    good = usable(F.col(vector)) & F.col(label).isNotNull() & F.col(id_).isNotNull()
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.where(good).select(F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"), double.alias("v"))
    marked = written(coded(rows, tables, hashes, probes), "vectors")
    classes = marked.groupBy("label", "print").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit"), F.first("codes").alias("codes")
    )
    # ids may repeat, so classes have names of their own
    classes = written(classes.withColumn("name", F.xxhash64("rep", "print", "label")), "classes")

    # lengths that pad to the same power of two have the same rotations, so a bucket is of one length
    length = F.octet_length("unit").alias("length")
    place = classes.select("label", length, "name", F.explode(F.array_distinct("codes")).alias("code"))
    bucket = ["label", "length", "code"]
    shared = place.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1")
    place = in_blocks(place.join(shared, bucket), "m", block, "name", "code")
    place = written(place.select(*bucket, "low", "high", "side", "name"), "buckets")
    full = place.join(classes.select("name", "rep", "n", "unit", "codes"), "name")
    key = [*bucket, "low", "high"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, key):
            if group.num_rows < 2:
                continue
            group = group.sort_by("rep")
            links, left, right = _linked(group, least)
            reps, names = group.column("rep").to_numpy(), group.column("name").to_numpy()
            some = np.flatnonzero(links)
            out = [(names[some], links[some], np.full(len(some), -1), np.full(len(some), -1)),
                   (np.full(len(left), 0), np.zeros(len(left), "i8"), reps[left], reps[right])]
            columns = [np.concatenate(c).astype("i8") for c in zip(*out)]
            mask = [None, None, columns[1] > 0, columns[1] > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64(), mask=m) for c, m in zip(columns, mask)], names=["name", "links", "a", "b"]
            )

    dealt = full.repartition(*key).sortWithinPartitions(*key)
    found = written(dealt.mapInArrow(link, "name long, links long, a long, b long"), "vector-links")
    counts = found.where("links > 0").groupBy("name").agg(F.sum("links").alias("links"))
    home = components(found.where("a IS NOT NULL").select("a", "b").distinct(), "a", "b")
    classes = classes.select("label", "print", "name", "rep", "n").join(counts, "name", "left")
    classes = classes.join(home.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "print",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    linked = marked.select("id", "label", "print").join(written(classes, "vector-classes"), ["label", "print"])
    linked = linked.select("id", "n_links", "component_id")
    # zero vectors pass the test above, but have no class
    bad = vectors.select(F.col(id_).cast("long").alias("id"), (~good | ~F.exists(vector, lambda x: x != 0)).alias("bad"))
    alone = bad.where("bad").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
