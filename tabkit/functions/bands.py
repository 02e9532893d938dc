"""Right-closed bands: the first one also takes its left edge; values outside are missing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators.quantiles import quantiles
from tabkit.session import as_col, one_row

# Band edges and labels of the reports.
USE_EDGES = [0.0, 50.0, 100.0, 150.0, 250.0, math.inf]
USE_LABELS = ["0-50", "51-100", "101-150", "151-250", "250+"]
SCORE_EDGES = [0.0, 25.0, 50.0, 75.0, 100.0]
SCORE_LABELS = ["1-25", "26-50", "51-75", "76-100"]
VINTAGE_EDGES = [-math.inf, 1939.0, 1979.0, 1999.0, math.inf]
VINTAGE_LABELS = ["Pre-1940", "1940-1979", "1980-1999", "2000 and later"]
SIZE_LABELS = ["Small", "Medium", "Large", "Very Large"]


def fixed_bands(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    if len(edges) != len(labels) + 1:
        raise ValueError("there must be one more edge than labels")
    x = as_col(c)
    label = F.when(x < F.lit(float(edges[0])), F.lit(None).cast("string"))
    for upper, name in zip(edges[1:], labels):
        inside = x.isNotNull() if upper == math.inf else x <= F.lit(float(upper))
        label = label.when(inside, F.lit(name))
    return label


def quantile_bands(
    df: DataFrame, column: str, out: str, labels: Sequence[str] = SIZE_LABELS, fit_on: DataFrame | None = None
) -> DataFrame:
    """Bands with equal shares of rows. Equal edges merge and the lowest label wins."""
    k = len(labels)
    source = df if fit_on is None else fit_on
    edges = one_row(quantiles(source, {f"e{i}": (column, i / k) for i in range(k + 1)}))
    values = [edges[f"e{i}"] for i in range(k + 1)]
    if values[0] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumn(out, fixed_bands(F.col(column).cast("double"), values, labels))


def band_table(spark, labels: Sequence[str], name: str = "band") -> DataFrame:
    """All bands in order, to keep the empty ones in a report."""
    return spark.createDataFrame(
        [(i + 1, label) for i, label in enumerate(labels)], f"band_order int, {name} string"
    )
