"""Errors of predictions: overall, by band, by group, and of two models against each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.bands import band_table
from tabkit.functions.numbers import mae, r2, rmse
from tabkit.operators.quantiles import quantiles
from tabkit.session import one_row, settle


def with_errors(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """residual = actual - predicted, error = predicted - actual, abs_error."""
    gap = F.col(actual) - F.col(pred)
    return df.withColumns({"residual": gap, "error": -gap, "abs_error": F.abs(gap)})


def model_metrics(df: DataFrame, actual: str, preds: Mapping[str, str], with_range: bool = True) -> DataFrame:
    """One row per model (name -> prediction column), all from one pass, plus one for the tail quantile."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.struct(
                F.lit(name).alias("model"),
                mae(actual, p).alias("mae"),
                rmse(actual, p).alias("rmse"),
                r2(actual, p).alias("r2"),
                *([F.min(p).alias("pred_min"), F.max(p).alias("pred_max")] if with_range else []),
            ).alias(f"m{i}")
            for i, (name, p) in enumerate(preds.items())
        ]
    )
    if with_range:
        wide, _ = settle(wide)
    found = wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(preds))])))
    if not with_range:
        return found
    rows = wide.first()["rows"]
    tails = one_row(quantiles(df, {p: (p, 0.995) for p in set(preds.values())}, known_rows=rows))
    lookup = F.create_map(
        *[x for name, p in preds.items() for x in (F.lit(name), F.lit(tails[p]).cast("double"))]
    )
    return found.select(
        "model", "mae", "rmse", "r2", "pred_min", lookup[F.col("model")].alias("pred_p995"), "pred_max"
    )


def _group_measures(actual: str, pred: str) -> list:
    return [
        F.count(F.lit(1)).alias("n"),
        mae(actual, pred).alias("mae"),
        rmse(actual, pred).alias("rmse"),
        r2(actual, pred).alias("r2"),
        F.avg(pred).alias("pred_mean"),
        F.avg(actual).alias("actual_mean"),
    ]


def subgroup_errors(
    df: DataFrame, group: str, actual: str = "actual", pred: str = "pred", min_count: int = 100
) -> DataFrame:
    """Errors per group of at least `min_count` rows, hardest first. Missing is a group of its own."""
    if group not in df.columns:
        raise KeyError(group)
    return (
        df.groupBy(group)
        .agg(*_group_measures(actual, pred))
        .where(F.col("n") >= min_count)
        .orderBy(F.desc("rmse"), F.desc("mae"))
    )


def subgroup_reports(
    df: DataFrame, groups: Mapping[str, str], actual: str = "actual", pred: str = "pred", min_count: int = 100
) -> DataFrame:
    """`subgroup_errors` for several groupings (report name -> column) with one scan and one shuffle."""
    columns = list(groups.values())
    keyed = df.select(*[F.col(c).cast("string").alias(c) for c in columns], F.col(actual).alias("__a"), F.col(pred).alias("__p"))
    grouped = keyed.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        *[F.grouping(c).alias(f"__g{i}") for i, c in enumerate(columns)], *_group_measures("__a", "__p")
    )
    report = F.coalesce(
        *[F.when(F.col(f"__g{i}") == 0, F.lit(name)) for i, name in enumerate(groups)]
    )
    value = F.coalesce(*[F.when(F.col(f"__g{i}") == 0, F.col(c)) for i, c in enumerate(columns)])
    return grouped.where(F.col("n") >= min_count).select(
        report.alias("report"), value.alias("group_value"), "n", "mae", "rmse", "r2", "pred_mean", "actual_mean"
    )


def _sliced(df: DataFrame, by: str, wide: bool) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae")]
    if wide:
        measures += [
            F.avg("actual").alias("mean_actual"),
            F.avg("pred").alias("mean_predicted"),
            F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        ]
    present = df.where(F.col(by).isNotNull())
    found, _ = settle(present.groupBy(by).agg(*measures))
    rows = found.agg(F.sum("n")).first()[0] or 0
    middle = quantiles(present, {"median_ae": ("abs_error", 0.5)}, by=[by], known_rows=rows)
    return found.join(middle, by, "left")


def band_errors(df: DataFrame, band: str, labels: Sequence[str], wide: bool = False) -> DataFrame:
    """Errors per band in order. Bands without rows stay, with n = 0."""
    found = _sliced(df, band, wide)
    every = F.broadcast(band_table(df.sparkSession, labels, band))
    kept = every.join(found, band, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return kept.orderBy("band_order")


def category_errors(df: DataFrame, category: str, min_count: int = 1, wide: bool = False) -> DataFrame:
    """Errors per category of at least `min_count` rows, hardest first; missing categories left out."""
    return (
        _sliced(df, category, wide)
        .where(F.col("n") >= min_count)
        .orderBy(F.desc("mae"), F.desc("n"), category)
    )


def hardest_and_easiest(errors: DataFrame, category: str, k: int = 10) -> DataFrame:
    hard = errors.orderBy(F.desc("mae"), category).limit(k).withColumn("side", F.lit("hardest"))
    easy = errors.orderBy("mae", category).limit(k).withColumn("side", F.lit("easiest"))
    return hard.unionByName(easy)


def range_diagnosis(df: DataFrame, actual: str, pred: str, pred_log: str | None = None) -> DataFrame:
    """Are predictions plausible against the range of the actual values?"""
    rows, top = df.agg(F.count(F.lit(1)), F.max(actual)).first()
    tails = {"actual_p99": (actual, 0.99), "pred_p99": (pred, 0.99), "pred_p995": (pred, 0.995)}
    if pred_log:
        tails["pred_log_p99"] = (pred_log, 0.99)
    found = one_row(quantiles(df, tails, known_rows=rows))
    measures = [
        F.min(actual).alias("actual_min"),
        F.max(actual).alias("actual_max"),
        F.min(pred).alias("pred_min"),
        F.max(pred).alias("pred_max"),
    ]
    for times, name in ((1.0, "above_max"), (2.0, "above_2x_max"), (5.0, "above_5x_max")):
        measures.append(F.count_if(F.col(pred) > F.lit(top) * times).alias(f"count_{name}"))
    if pred_log:
        measures.append(F.max(pred_log).alias("pred_log_max"))
    return df.agg(*measures).withColumns({k: F.lit(v).cast("double") for k, v in found.items()})


def worst_rows(df: DataFrame, n: int = 20, key: Sequence[str] = ()) -> DataFrame:
    """Largest absolute errors, then largest predictions, then smallest `key`, which settles ties at the cut."""
    return df.orderBy(F.desc("abs_error"), F.desc("pred"), *key).limit(n)


def compare_two(df: DataFrame, actual: str, first: str, second: str, names: tuple[str, str]) -> DataFrame:
    """Per row: both absolute errors, the improvement of the second, and which one is closer."""
    a, b = F.abs(F.col(actual) - F.col(first)), F.abs(F.col(actual) - F.col(second))
    gain = a - b
    return df.withColumns(
        {
            "first_abs_error": a,
            "second_abs_error": b,
            "error_improvement": gain,
            "winner": F.when(gain > 0, names[1]).when(gain < 0, names[0]).otherwise("Tie"),
        }
    )


def metric_table(metrics: DataFrame, baseline: str, tuned: str) -> DataFrame:
    """Metric by row: baseline, tuned and the change."""
    long = metrics.where(F.col("model").isin(baseline, tuned)).unpivot(
        "model", ["mae", "rmse", "r2"], "metric", "value"
    )
    return (
        long.groupBy("metric")
        .agg(
            F.max(F.when(F.col("model") == baseline, F.col("value"))).alias("baseline"),
            F.max(F.when(F.col("model") == tuned, F.col("value"))).alias("tuned"),
        )
        .withColumn("delta", F.col("tuned") - F.col("baseline"))
    )


def rmse_gain(metrics: DataFrame, dummy: str) -> DataFrame:
    """Best model and its RMSE gain over the dummy model, in percent."""
    best = metrics.agg(
        F.min_by("model", "rmse").alias("best_model"),
        F.min("rmse").alias("best_rmse"),
        F.max(F.when(F.col("model") == dummy, F.col("rmse"))).alias("dummy_rmse"),
    )
    gain = F.try_divide(F.col("dummy_rmse") - F.col("best_rmse"), F.col("dummy_rmse")) * 100
    return best.withColumn("gain_pct", gain)


def best_models(metrics: DataFrame, by: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Per scenario the learned model with the least RMSE, then MAE (baselines excluded)."""
    order = F.struct("rmse", "mae", "model")
    kept = metrics.where(~F.col("model").isin(list(exclude))) if exclude else metrics
    return kept.groupBy(*by).agg(
        F.min_by(F.struct("model", "mae", "rmse", "r2"), order).alias("best")
    ).select(*by, "best.*")


def mark_selected(metrics: DataFrame, model: str) -> DataFrame:
    return metrics.withColumn("selected", F.col("model") == F.lit(model))


def metric_pivot(metrics: DataFrame, metric: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Mean of a metric, models by rows and scenarios by columns."""
    return metrics.groupBy("model").pivot(columns, list(values)).agg(F.avg(metric))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts of two categories, absent cells 0, rows with a missing side left out.

    Without `values` the column headers are the distinct categories, found in one more pass.
    """
    both = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    counts = both.groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy(rows).pivot(columns, list(values) if values else None).agg(F.sum("n"))
    return grid.na.fill(0)


def crosstab_share(df: DataFrame, rows: str, columns: str, digits: int = 2) -> DataFrame:
    """Long form: share of each cell in its row, in percent, over all pairs of categories seen; absent cells 0."""
    both = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    counts = both.groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))
    # like the headers of `crosstab`, the categories of the second column are a list
    names = F.lit([r[0] for r in counts.select(columns).distinct().collect()] or None).cast(T.ArrayType(df.schema[columns].dataType))
    grid = counts.groupBy(rows).agg(F.sum("n").alias("__whole")).withColumn(columns, F.explode(names))
    found = grid.join(counts, [rows, columns], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.select(rows, columns, "n", F.bround(F.col("n") * 100.0 / F.col("__whole"), digits).alias("row_pct"))


def long_errors(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Unpivot absolute errors to (model, abs_error)."""
    renamed = df.withColumnsRenamed({c: name for name, c in columns.items()})
    return renamed.unpivot(list(keys), list(columns), "model", "abs_error")
