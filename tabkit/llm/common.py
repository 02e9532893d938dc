"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.session import written

WORD = r"[^\x20\x09-\x0D]+"


def fold(key: str, folds: int) -> Column:
    """crc32 of a key's text modulo `folds`; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, the same in every run and engine."""
    parts = [F.coalesce(k.cast("string"), F.lit("~")) for k in keys]
    head = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), 1, 12)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**12))


def stratified(rows: DataFrame, by: str, key: str, size: int, seed: int = 17) -> DataFrame:
    """About `size` keys of each value of `by` at most, chosen by a hash of `key`; null values go.

    A sample to fit models on: equal keys are taken or left together, and the rates count each key of a value once, so
    copies do not thin out the sample. The values' rates are broadcast up to 100,000 values, which are counted.
    """
    rows = rows.where(F.col(by).isNotNull())
    rates = rows.select(by, key).distinct().groupBy(by).agg((F.lit(float(size)) / F.count("*")).alias("__rate"))
    rates = written(rates, "rates")
    rates = F.broadcast(rates) if rates.count() <= 100_000 else rates
    return rows.join(rates, by).where(uniform(seed, F.col(key)) < F.col("__rate")).select(*rows.columns)


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, size: int, folds: int, left_out: int, id_: str = "doc_id", text: str = "text"
) -> DataFrame:
    """label, text, key (hash of the text), weight: distinct texts of at most about `size` labelled rows of each class.

    Rows of fold `left_out` are not learned from; labels other than 0 and 1 and null texts are left out, several labels
    of an id count as their largest. weight restores the classes' shares.
    """
    known = labels.where((fold(id_, folds) != left_out) & F.col(label).isin(0, 1))
    known = written(known.groupBy(F.col(id_).alias("id")).agg(F.max(label).cast("int").alias("label")), "labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = F.broadcast(stratified(known, "label", "id", size))
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(chosen, "id")
    rows = rows.withColumn("key", F.xxhash64("text"))
    weight = F.when(F.col("label") == 1, F.lit(max(1.0, counts.get(1, 0) / size))).otherwise(F.lit(max(1.0, counts.get(0, 0) / size)))
    rows = rows.groupBy("key").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return written(rows.select("label", "text", "key", weight.alias("weight")), "labelled")


def summary(table: DataFrame) -> tuple:
    """Count and sum of the hashes of a table's rows: equal for tables of the same distinct rows."""
    return tuple(table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node, component: the smallest id that each id on a link can reach.

    Alternating large-star and small-star rounds. Each round is written to the shared folder, aggregates
    combine before they shuffle, and a hot id is only ever the large side of a join, which Spark splits.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    pairs = written(links.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "links")
    state = summary(pairs)
    while state[0]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large.distinct(), "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = written(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        pairs, before, state = small, state, summary(small)
        if state == before:
            break
    roots = pairs.select("lo").distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    )


def counted(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The distinct ids (one number each) as a written table; up to `most`, which are counted, are to be broadcast."""
    ids = written(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= most else ids


def in_blocks(members: DataFrame, size: str, block: int, *names: str) -> DataFrame:
    """Cut groups of `size` members into blocks of about `block`, dealt by a hash of `names`, that meet pairwise.

    A member comes once for each block of its group, in the group (low, high) of the two blocks; side is its own.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
        start = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, k
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of n points reaches over the links left[i] - right[i]."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root
