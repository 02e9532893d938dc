"""Domain rules, value caps and row filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.numbers import clip
from tabkit.operators.quantiles import quantiles
from tabkit.session import one_row


@dataclass(frozen=True)
class Domain:
    """Valid range of a column. `above` excludes its bound, `at_least` and `at_most` include theirs."""

    column: str
    at_least: float | None = None
    at_most: float | None = None
    above: float | None = None

    def broken(self, c: Column) -> Column:
        tests = []
        if self.at_least is not None:
            tests.append(c < F.lit(self.at_least))
        if self.at_most is not None:
            tests.append(c > F.lit(self.at_most))
        if self.above is not None:
            tests.append(c <= F.lit(self.above))
        found = tests[0]
        for test in tests[1:]:
            found = found | test
        return found


def apply_domains(df: DataFrame, rules: Sequence[Domain]) -> DataFrame:
    """Set values outside their domain to missing, all columns in one projection."""
    known = [r for r in rules if r.column in df.columns]
    return df.withColumns(
        {r.column: F.when(~r.broken(F.col(f"`{r.column}`")), F.col(f"`{r.column}`")) for r in known}
    )


def positive_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every column is above zero; missing fails."""
    for c in columns:
        df = df.where(F.col(c) > 0)
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows remain: {what}")
    return df


def retention(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before, rows kept and the kept share in percent, from one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(keep).alias("rows_kept")).withColumn(
        "retention_pct", F.bround(F.try_divide(F.col("rows_kept"), F.col("rows_before")) * 100, 2)
    )


def upper_bound(df: DataFrame, column: str, q: float) -> float | None:
    return one_row(quantiles(df, {"bound": (column, q)}))["bound"]


def at_most(df: DataFrame, column: str, bound: float) -> Column:
    """Upper bound in the column's own type, so that the scan can skip row groups."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return F.col(column) <= F.lit(math.floor(bound))
    return F.col(column) <= F.lit(float(bound))


def cap_rows(df: DataFrame, column: str, q: float | None) -> tuple[DataFrame, float | None]:
    """Rows with 0 < value <= the q-quantile; the bound is inlined."""
    kept = df.where(F.col(column) > 0)
    if q is None or q >= 1.0:
        return kept, None
    bound = upper_bound(df, column, q)
    return kept.where(at_most(df, column, bound)), bound


def winsor_bounds(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict:
    wanted = {}
    for c in columns:
        wanted[f"{c}|low"] = (c, low)
        wanted[f"{c}|high"] = (c, high)
    found = one_row(quantiles(df, wanted))
    return {c: (found[f"{c}|low"], found[f"{c}|high"]) for c in columns}


def winsorize(df: DataFrame, columns: dict[str, str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip columns at their quantiles; `columns` maps source to output name."""
    bounds = winsor_bounds(df, list(columns), low, high)
    return df.withColumns({out: clip(F.col(c).cast("double"), *bounds[c]) for c, out in columns.items()})


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A top-k report; runs as a per-partition top-k and one merge."""
    return df.orderBy(*order).limit(n)


def sample_rows(
    df: DataFrame, n: int, key: str, seed: int = 42, order: Column | None = None
) -> DataFrame:
    """Exactly min(n, rows) rows in the order of a seeded hash of the key, whatever the partitioning."""
    order = F.xxhash64(F.col(key), F.lit(seed)) if order is None else order
    return df.orderBy(order, key).limit(n)
