"""Ranks and equal-sized tiles with ties broken by a unique key of any orderable type.

Tiles need no global sort: the tile borders are a few (value, key) pairs at known ranks, found by
selection, and every row is compared with those pairs. A value that fills several tiles is split by
its keys. Ranks deal the rows out by ranges of (value, key) and add up the ranges' sizes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.names import content_id, own_id, stable_id
from tabkit.operators.quantiles import is_small, values_at_ranks
from tabkit.session import attach, join_large, settle, written

# Up to here one task numbers all rows for tiles; the labels are the same beyond.
SMALL_RANKS = 1_000_000
# Row numbers within a partition are the low bits of monotonically_increasing_id.
ROW_BITS = (1 << 33) - 1


def placed_by(df: DataFrame, column: str) -> Callable[[Column], Column]:
    """A function from values of the column to doubles that never fall as the values grow.

    Texts are placed by the six bytes after the start that all of them share.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date
    if isinstance(kind, T.BooleanType):
        return lambda x: x.cast("int").cast("double")
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        return lambda x: x.cast("double")
    ends = df.agg(F.min(column).cast("binary"), F.max(column).cast("binary")).first()
    shared = len(os.path.commonprefix([bytes(e or b"") for e in ends]))

    def place(x: Column) -> Column:
        head = F.hex(F.substring(x.cast("binary"), shared + 1, 6))
        return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")

    return place


def tile_borders(df: DataFrame, value: str, key: str, tiles: int) -> tuple[int, list[tuple]]:
    """Number of non-missing values, and the last (value, key) of each tile but the last.

    The last 0-based rank of tile j among n is floor(j * (n - 1) / tiles). `key` is unique.
    """
    rows = df.select(F.col(value).alias("x"), F.col(key).alias("k")).where("x is not null")
    found = values_at_ranks(
        rows,
        {"x": F.col("x")},
        [],
        lambda _, n: [(str(j), F.floor(F.lit(j) * (n - 1) / F.lit(tiles))) for j in range(1, tiles)],
        placed_by(rows, "x"),
    ).collect()
    tied = {int(f["t"]): f for f in found if f["n"]}
    if not tied:
        return 0, []
    size = found[0]["n"]
    at = rows.where(F.col("x").isin(sorted({f["v"] for f in tied.values()}))).withColumnRenamed("x", "tie")
    keys = values_at_ranks(
        at,
        {"k": F.col("k")},
        ["tie"],
        lambda _, n: [
            (str(j), F.when(F.col("tie") == F.lit(f["v"]), F.lit(f["r"] - f["below"])))
            for j, f in tied.items()
        ],
        placed_by(at, "k"),
    ).collect()
    by_tile = {int(k["t"]): (k["tie"], k["v"]) for k in keys}
    return size, [by_tile[j] for j in sorted(by_tile)]


def tile_of(value: Column, key: Column, borders: list[tuple]) -> Column:
    """1-based tile by binary search over the borders, written as nested conditions."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        v, k = borders[middle]
        reaches = (value < F.lit(v)) | ((value == F.lit(v)) & (key <= F.lit(k)))
        return F.when(reaches, search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(value.isNotNull(), search(0, len(borders)))


def assign_deciles(
    df: DataFrame,
    value: str,
    key: str,
    out: str,
    prefix: str,
    tiles: int = 10,
    small_rows: int | None = None,
) -> DataFrame:
    """Label "prefix k" by rank among the non-missing values; missing stay missing, one value alone too.

    Row number rn of n gets k = max(1, ceil((rn - 1) * tiles / (n - 1))).
    """
    if is_small(df, SMALL_RANKS if small_rows is None else small_rows):
        order = Window.orderBy(F.col(value).asc_nulls_last(), F.col(key))
        total = F.count(value).over(Window.partitionBy())
        ranked = df.withColumns({"__rn": F.row_number().over(order), "__n": total})
        tile = F.expr(f"greatest(1, ((__rn - 1L) * {int(tiles)} + (__n - 2)) div nullif(__n - 1, 0))")
        usable = F.col(value).isNotNull() & (F.col("__n") > 1)
        return ranked.withColumn(
            out, F.when(usable, F.concat(F.lit(f"{prefix} "), tile.cast("string")))
        ).drop("__rn", "__n")
    size, borders = tile_borders(df, value, key, tiles)
    if size < 2:
        return df.withColumn(out, F.lit(None).cast("string"))
    tile = tile_of(F.col(value), F.col(key), borders)
    label = F.concat(F.lit(f"{prefix} "), tile.cast("string"))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), label))


def rank_rows(df: DataFrame, value: str, key: str, out: str = "rn") -> DataFrame:
    """1-based rank of the non-missing values, ties by key; missing values get no rank.

    Rows are dealt out by ranges of (value, key), so a frequent value is split too, sorted, and numbered within
    their range; the sizes of the ranges before it are added.
    """
    ranged = df.where(F.col(value).isNotNull()).repartitionByRange(value, key).sortWithinPartitions(value, key)
    here = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    ranged = written(ranged.withColumns({"__part": F.spark_partition_id(), "__here": here}), "ranks")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = ranged.join(F.broadcast(sizes), "__part")
    ranked = ranked.select(*df.columns, (F.col("__before") + F.col("__here") + 1).alias(out))
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("long")))


def with_row_id(df: DataFrame, id_columns: Sequence[str], out: str) -> DataFrame:
    """`names.stable_id` as a column, unique also for equal rows without an id: these copies are numbered.

    Only contents of rows without an id are counted. Copies are numbered over ranges of rows, so many copies of one
    row are no hot spot; which copy gets which number is all the same.
    """
    own = own_id(df, id_columns)
    nameless = df.where(own.isNull()).withColumn("__content", content_id(df))
    counts = nameless.groupBy("__content").agg(F.count(F.lit(1)).alias("__copies"))
    repeated, small = settle(counts.where("__copies > 1"))
    if small and repeated.isEmpty():
        return df.withColumn(out, stable_id(df, id_columns))
    nameless = nameless.join(F.broadcast(repeated), "__content", "left") if small else join_large(
        nameless, repeated, ["__content"], weight="__copies"
    )
    nameless = written(nameless.withColumn("__row", F.monotonically_increasing_id()), "nameless")
    ranked = written(rank_rows(nameless.where("__copies > 1"), "__content", "__row", "__rank"), "copies")
    first = ranked.groupBy("__content").agg(F.min("__rank").alias("__first"), F.max("__copies").alias("__n"))
    ranked = attach(ranked, first, ["__content"], "inner", weight="__n")
    numbered = F.concat("__content", F.lit("_"), (F.col("__rank") - F.col("__first")).cast("string"))
    cells = [F.col(f"`{c}`") for c in df.columns if c != out]
    return (
        df.where(own.isNotNull()).select(*cells, own.alias(out))
        .unionByName(nameless.where("__copies is null").select(*cells, F.col("__content").alias(out)))
        .unionByName(ranked.select(*cells, numbered.alias(out)))
    )
