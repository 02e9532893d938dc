"""Row-level arithmetic and aggregate formulas, all as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabkit.session import as_col


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, missing where b is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def ratio_or_zero(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def row_sum(columns: Sequence[str | Column]) -> Column:
    """Sum across columns, missing counted as 0."""
    return reduce(lambda x, y: x + y, [F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in columns])


def missing_flag(c: str | Column) -> Column:
    return as_col(c).isNull().cast("int")


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; missing stays missing, which `greatest` and `least` would not keep."""
    x = as_col(c)
    out = x
    if high is not None:
        out = F.when(x > F.lit(high), F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(x < F.lit(low), F.lit(low)).otherwise(out)
    return out


def skew(c: str | Column) -> Column:
    """Bias-corrected skewness of a group; missing below three values."""
    x = as_col(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def mae(actual: str | Column, pred: str | Column) -> Column:
    return F.avg(F.abs(as_col(actual) - as_col(pred)))


def rmse(actual: str | Column, pred: str | Column) -> Column:
    r = as_col(actual) - as_col(pred)
    return F.sqrt(F.avg(r * r))


def r2(actual: str | Column, pred: str | Column) -> Column:
    """1 - squared error / spread; with no spread 1 if there is no error, else 0."""
    y, r = as_col(actual), as_col(actual) - as_col(pred)
    spread = F.count(y) * F.var_pop(y)
    flat = F.when(F.sum(r * r) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(spread == 0, flat).otherwise(F.lit(1.0) - F.try_divide(F.sum(r * r), spread))


def half_even(c: str | Column, digits: int) -> Column:
    return F.bround(as_col(c), digits)
