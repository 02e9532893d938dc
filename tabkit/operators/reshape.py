"""Reshaping of small result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(df: DataFrame, id_column: str, measures: Sequence[str], ids: Sequence[str], name: str) -> DataFrame:
    """Measures by rows and ids by columns; measures are read as doubles."""
    cast = df.select(id_column, *[F.col(m).cast("double").alias(m) for m in measures])
    long = cast.unpivot(id_column, list(measures), name, "value")
    return long.groupBy(name).pivot(id_column, list(ids)).agg(F.first("value"))


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack result tables by column name; columns missing in one are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def missing_from(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of the left table that the right one lacks."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")
