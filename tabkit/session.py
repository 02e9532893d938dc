"""Session defaults, the shared work folder, and the size-checked small table."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest fitted table that is sent to every executor. Larger ones are joined by shuffle.
SETTLE_ROWS = 20_000
SETTLE_BYTES = 64 << 20


def build_session(app: str = "tabkit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time. On a cluster, leave `master` unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`, or a temporary one in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="tabkit-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table or artefact in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tabkit/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor costs only its own tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage and long expressions end here, and
    later readers prune columns. For frames that several jobs read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def settle(table: DataFrame, max_rows: int = SETTLE_ROWS, max_bytes: int = SETTLE_BYTES) -> tuple[DataFrame, bool]:
    """Compute a fitted table once. Returns it and whether it is proven small, in rows and in bytes of texts and lists.

    At most `max_rows` + 1 rows reach the driver; a larger table is kept in the shared folder.
    """
    held = table.storageLevel
    mine = not (held.useMemory or held.useDisk)
    if mine:  # a table that proves large is not computed again to be stored
        table = table.persist(StorageLevel.DISK_ONLY)
    try:
        rows = table.limit(max_rows + 1).collect()
        size = sum(len(v) for r in rows for v in r if isinstance(v, (str, bytes, bytearray, list, dict)))
        if len(rows) <= max_rows and size <= max_bytes:
            return table.sparkSession.createDataFrame(rows, table.schema), True
        return checkpointed(table), False
    finally:
        if mine:
            table.unpersist()


def attach(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = SETTLE_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Join a table with one row per key to many rows: broadcast up to `max_rows` rows, else `join_large`."""
    table, small = settle(table, max_rows)
    if small:
        return rows.join(F.broadcast(table), on, how)
    return join_large(rows, table, on, how, weight)


def join_large(
    rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", weight: str | None = None
) -> DataFrame:
    """Join with a settled table that is too large to broadcast.

    Keys that hold at least one 2,000th of all rows (column `weight` counts them; there can be at most
    2,000) are broadcast and the others joined by shuffle, so that no hot key lands in one task. Without `weight` it is
    left to Spark to split hot keys. Rows with a missing key match nothing and go around the join.
    """
    missing = reduce(or_, [F.col(f"`{c}`").isNull() for c in on])
    alone = rows.where(missing)
    rows = rows.where(~missing)
    if weight is None:
        joined = rows.join(table, on, how)
    else:
        joined = _join_hot_apart(rows, table, on, how, weight)
    if how != "left":
        return joined
    added = {f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in on}
    return joined.unionByName(alone.withColumns(added))


def _join_hot_apart(rows: DataFrame, table: DataFrame, on: list[str], how: str, weight: str) -> DataFrame:
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * 2000 >= F.lit(total)
    hot = table.where(is_hot)
    spread = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on, "inner").unionByName(
        spread.join(table.where(~is_hot), on, how)
    )


def one_row(table: DataFrame) -> dict:
    """The single row of a global aggregate, as plain values to inline as literals."""
    return table.first().asDict()


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
