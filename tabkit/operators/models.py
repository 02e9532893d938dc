"""Model recipes, comparison and tuning. Every recipe is one pipeline fitted on training rows only."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.numbers import rmse
from tabkit.operators import trees as T
from tabkit.operators.boosting import BoostedRegressor
from tabkit.operators.coding import CategoryCoder
from tabkit.operators.evaluate import model_metrics
from tabkit.operators.quantiles import quantiles
from tabkit.operators.split import hash_slot
from tabkit.operators.stages import (
    CategoryMeanRegressor,
    GroupMedianFill,
    MeanRegressor,
    MedianFill,
    ModeFill,
    PopulationScaler,
    RareGrouper,
    RidgeRegression,
)
from tabkit.session import written

MAX_DEPTH = 30

# Tuning settings and search spaces of the analyses.
FOREST_SETTINGS = {
    "baseline_like": {"numTrees": 200, "minInstancesPerNode": 2},
    "more_trees": {"numTrees": 300, "minInstancesPerNode": 2},
    "more_trees_wider": {"numTrees": 400, "minInstancesPerNode": 2},
    "slightly_smoother": {"numTrees": 300, "minInstancesPerNode": 3},
    "reduced_features": {"numTrees": 300, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.8"},
    "deeper_controlled": {"numTrees": 300, "minInstancesPerNode": 2, "maxDepth": 20},
    "more_regularized": {"numTrees": 300, "minInstancesPerNode": 4},
}
SCORE_SPACE = {
    "numTrees": [100, 200, 300],
    "maxDepth": [MAX_DEPTH, 10, 20],
    "minInstancesPerNode": [1, 2],
    "featureSubsetStrategy": ["sqrt", "log2"],
}
# Depth is unlimited in the first place, and 30 in the last, which is the most that Spark grows.
EMISSION_SPACE = {
    "numTrees": [200, 300, 500],
    "maxDepth": [MAX_DEPTH, 12, 20, MAX_DEPTH],
    "leastSplit": [2, 5, 10],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "0.8", "all"],
}


@dataclass(frozen=True)
class Features:
    """Columns of a model and how its missing and rare categories are treated."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    missing_category: str = "label"  # "label", "mode" or "own"
    min_category_count: int | None = 200
    group_fill: Mapping[str, str] = field(default_factory=dict)  # numeric column -> group column

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def _filling(features: Features) -> tuple[list, list[str]]:
    numeric = list(features.numeric)
    filled = [f"__fill{i}" for i in range(len(numeric))]
    stages: list = []
    for group in sorted(set(features.group_fill.values())):
        mine = [c for c in numeric if features.group_fill.get(c) == group]
        stages.append(
            GroupMedianFill(inputCols=mine, outputCols=[filled[numeric.index(c)] for c in mine], groupCol=group)
        )
    plain = [c for c in numeric if c not in features.group_fill]
    if plain:
        stages.append(MedianFill(inputCols=plain, outputCols=[filled[numeric.index(c)] for c in plain]))
    return stages, filled


def _encoding(features: Features) -> tuple[list, list[str]]:
    categorical = list(features.categorical)
    if not categorical:
        return [], []
    named = [f"__cat{i}" for i in range(len(categorical))]
    coded = [f"__hot{i}" for i in range(len(categorical))]
    stages: list = []
    source = categorical
    if features.missing_category == "mode":
        stages.append(ModeFill(inputCols=categorical, outputCols=named))
        source = named
    if features.missing_category != "mode" or features.min_category_count:
        least = features.min_category_count or 1
        stages.append(RareGrouper(inputCols=source, outputCols=named, minCount=least))
    stages.append(CategoryCoder(inputCols=named, outputCols=coded))
    return stages, coded


def shared_preparation(features: Features) -> dict[bool, list]:
    """Stages for unscaled (False) and scaled (True) models; both start with the same stage objects, so
    `fit_shared` fits those once."""
    fills, filled = _filling(features)
    codes, coded = _encoding(features)
    common = fills + codes
    scaled = [f"__std{i}" for i in range(len(filled))]
    scaler = [PopulationScaler(inputCols=filled, outputCols=scaled)] if filled else []
    return {
        False: [*common, VectorAssembler(inputCols=filled + coded, outputCol="features")],
        True: [*common, *scaler, VectorAssembler(inputCols=scaled + coded, outputCol="features")],
    }


def preprocessing(features: Features, scaled: bool) -> list:
    """Fill, group and encode, optionally scale, then assemble; other columns pass through untouched."""
    return shared_preparation(features)[scaled]


def least_squares(label: str) -> LinearRegression:
    """Ordinary least squares. One-hot columns add up to the intercept column, so the solution is not
    unique; a vanishing penalty picks the one with the smallest coefficients."""
    return LinearRegression(labelCol=label, regParam=1e-9, elasticNetParam=0.0, standardization=False)


def forest(label: str, seed: int = 42, **settings) -> T.ForestRegressor:
    chosen = {"numTrees": 300, "maxDepth": MAX_DEPTH, "minInstancesPerNode": 2, "featureSubsetStrategy": "all"}
    return T.ForestRegressor(labelCol=label, seed=seed, **{**chosen, **settings})


def boosted(label: str, seed: int = 42, **settings) -> BoostedRegressor:
    chosen = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "l2": 1.0}
    return BoostedRegressor(labelCol=label, seed=seed, **{**chosen, **settings})


def boosted_unpenalised(label: str, seed: int = 42, **settings) -> GBTRegressor:
    """Spark's own boosting: no L2 term, but less time per round where rows are sampled."""
    chosen = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
    return GBTRegressor(labelCol=label, seed=seed, **{**chosen, **settings})


def recipe(features: Features, model: Estimator, scaled: bool = False) -> Pipeline:
    return Pipeline(stages=[*preprocessing(features, scaled), model])


def candidate_models(
    features: Features,
    label: str,
    category_baseline: str | None = None,
    dummy: bool = False,
    forest_settings: Mapping | None = None,
    boosted_settings: Mapping | None = None,
) -> dict[str, Pipeline]:
    """The comparison set: baselines, linear models on scaled columns, trees on unscaled ones."""
    models: dict[str, Pipeline] = {}
    if dummy:
        models["mean"] = Pipeline(stages=[MeanRegressor(labelCol=label)])
    if category_baseline:
        models["category_mean"] = Pipeline(
            stages=[CategoryMeanRegressor(categoryCol=category_baseline, labelCol=label)]
        )
    prepared = shared_preparation(features)
    models["linear"] = Pipeline(stages=[*prepared[True], least_squares(label)])
    models["ridge"] = Pipeline(stages=[*prepared[True], RidgeRegression(alpha=1.0, labelCol=label)])
    models["forest"] = Pipeline(stages=[*prepared[False], forest(label, **(forest_settings or {}))])
    if boosted_settings is not None:
        models["boosted"] = Pipeline(stages=[*prepared[False], boosted(label, **boosted_settings)])
    return models


def spread(rows: DataFrame) -> DataFrame:
    """Persisted rows that keep all cores busy. Rows from few input splits are dealt out again; a table
    of many splits is left as it is, without a shuffle."""
    kept = rows.persist()
    used = kept.select(F.spark_partition_id().alias("p")).distinct().count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if used * 2 > cores:
        return kept
    dealt = kept.repartition(cores).persist()
    dealt.count()
    kept.unpersist()
    return dealt


def fit_shared(train: DataFrame, models: Mapping[str, Pipeline]) -> dict[str, PipelineModel]:
    """Fit pipelines that start with the same stage objects; each common beginning is fitted once."""
    train = spread(train)
    begun: dict[tuple, tuple[DataFrame, list]] = {(): (train, [])}
    ready: dict[tuple, DataFrame] = {}
    fitted = {}
    try:
        for name, pipeline in models.items():
            *early, last = pipeline.getStages()
            path: tuple = ()
            for stage in early:
                rows, done = begun[path]
                path = (*path, stage.uid)
                if path not in begun:
                    model = stage.fit(rows) if isinstance(stage, Estimator) else stage
                    begun[path] = (model.transform(rows), [*done, model])
            rows, done = begun[path]
            if path and path not in ready:
                # The last stage reads its rows many times, but only these two columns.
                ready[path] = rows.select("features", last.getLabelCol()).persist()
            fitted[name] = PipelineModel(stages=[*done, last.fit(ready.get(path, rows))])
    finally:
        for rows in (*ready.values(), train):
            rows.unpersist()
    return fitted


def settled_metrics(scored: DataFrame, label: str, names: Sequence[str], with_range: bool = True) -> DataFrame:
    """Metrics of the `pred_` columns as a small table; the rows are scored once for all aggregates."""
    narrow = scored.select(label, *[f"pred_{n}" for n in names]).persist()
    try:
        found = model_metrics(narrow, label, {n: f"pred_{n}" for n in names}, with_range)
        return scored.sparkSession.createDataFrame(found.collect(), found.schema).orderBy("rmse", "mae")
    finally:
        narrow.unpersist()


def predict_all(
    df: DataFrame, models: Mapping[str, PipelineModel], clip_at_zero: bool = False
) -> DataFrame:
    """One prediction column per model, all on the same row: nothing is aligned by position."""
    base = list(df.columns)
    out = df
    for name, model in models.items():
        scored = model.transform(out)
        value = F.greatest(F.col("prediction"), F.lit(0.0)) if clip_at_zero else F.col("prediction")
        base.append(f"pred_{name}")
        out = scored.withColumn(f"pred_{name}", value).select(*[F.col(f"`{c}`") for c in base])
    return out


def compare_models(
    train: DataFrame,
    test: DataFrame,
    models: Mapping[str, Pipeline],
    label: str,
    clip_at_zero: bool = False,
) -> tuple[DataFrame, dict[str, PipelineModel], DataFrame]:
    """Fit all, score the test rows once, rank by RMSE then MAE."""
    fitted = fit_shared(train, models)
    scored = predict_all(test, fitted, clip_at_zero)
    return settled_metrics(scored, label, list(fitted)), fitted, scored


def binned_rows(rows: DataFrame, features: Features, label: str, part: Column, fitted: Column) -> T.Binned:
    """Rows as bins. Fills, categories and borders are fitted once, on the rows where `fitted` holds."""
    kept = rows.select(*[F.col(f"`{c}`") for c in features.columns], F.col(f"`{label}`"), part.alias("__part"), fitted.alias("__fitted"))
    kept = written(kept, "rows-to-bin")
    prepared = Pipeline(stages=preprocessing(features, False)).fit(kept.where("__fitted"))
    return T.binned(prepared.transform(kept), label, "features", F.col("__part"), fitted=F.col("__fitted"))


def shared_forests(settings: Sequence[Mapping], label: str, seed: int, parts: Sequence[int]) -> tuple[list[T.Growth], list[list[int]], list[tuple[int, int]]]:
    """The forests to grow for a list of settings, the tree counts to read from each, and where each setting is found.

    Settings that differ in the number of trees alone are read from one forest: its first trees are the smaller one.
    """
    grown = [replace(forest(label, seed, **s).growth(), parts=tuple(parts)) for s in settings]
    kinds = list(dict.fromkeys(replace(g, trees=0) for g in grown))
    counts = [sorted({g.trees for g in grown if replace(g, trees=0) == k}) for k in kinds]
    where = [(kinds.index(replace(g, trees=0)), g.trees) for g in grown]
    return [replace(k, trees=c[-1]) for k, c in zip(kinds, counts)], counts, where


def scored_settings(data: T.Binned, settings: Sequence[Mapping], label: str, seed: int, train: Sequence[int], held: Sequence[int]) -> DataFrame:
    """no, y, part and one column p0, p1, ... per setting: forests grown from some parts of the rows, scored on others."""
    forests, counts, where = shared_forests(settings, label, seed, train)
    places = {at: i for i, at in enumerate((f, m) for f, marks in enumerate(counts) for m in marks)}
    scored = T.held_out(data, forests, counts, held)
    return scored.select("no", "y", "part", *[F.col("means")[places[at]].alias(f"p{i}") for i, at in enumerate(where)])


def validation_search(
    train: DataFrame,
    features: Features,
    label: str,
    key: str,
    settings: Mapping[str, Mapping] = FOREST_SETTINGS,
    seed: int = 42,
    smaller: Mapping | None = None,
) -> tuple[DataFrame, str, PipelineModel]:
    """Score named forest settings on an inner 20 % of the training rows; refit the best on all of them.

    `smaller` overrides entries of every setting, for trial runs.
    """
    held = hash_slot(key, 10_000, seed + 1) < 2000
    settings = {name: {**params, **(smaller or {})} for name, params in settings.items()}
    data = binned_rows(train, features, label, held.cast("int"), ~held)
    scored = scored_settings(data, list(settings.values()), label, seed, [0], [1])
    scored = scored.select(F.col("y").alias(label), *[F.col(f"p{i}").alias(f"pred_{name}") for i, name in enumerate(settings)])
    scored = written(scored, "scored-settings")  # trees grow once
    metrics = settled_metrics(scored, label, list(settings), with_range=False)
    best = metrics.first()["model"]
    final = fit_shared(train, {best: recipe(features, forest(label, seed, **settings[best]))})
    return metrics, best, final[best]


def drawn_settings(space: Mapping[str, Sequence], draws: int, seed: int) -> list[dict]:
    """Different random settings of a space, at most `draws`."""
    size = 1
    for options in space.values():
        size *= len(options)
    picked = []
    for index in random.Random(seed).sample(range(size), min(draws, size)):
        setting = {}
        for name, options in space.items():
            index, at = divmod(index, len(options))
            setting[name] = options[at]
        picked.append(setting)
    return picked


def fold_errors(
    train: DataFrame, features: Features, label: str, key: str, settings: Sequence[Mapping], folds: int = 3, seed: int = 42
) -> list[float]:
    """RMSE of each forest setting, averaged over folds of hashed keys.

    Fills, categories and bins are fitted once per fold, on the other folds; all settings grow side by side from them.
    """
    part = hash_slot(key, folds, seed + 2).cast("int")
    kept = train.select(*[F.col(f"`{c}`") for c in features.columns], F.col(f"`{label}`"), part.alias("__fold"))
    kept, part = written(kept, "rows-to-fold"), F.col("__fold")  # what `train` is made of is read once
    errors = [0.0] * len(settings)
    for fold in range(folds):
        data = binned_rows(kept, features, label, (part == fold).cast("int"), part != fold)
        scored = scored_settings(data, settings, label, seed, [0], [1])
        row = scored.agg(*[rmse("y", f"p{i}").alias(f"e{i}") for i in range(len(settings))]).first()
        errors = [a + b / folds for a, b in zip(errors, row)]
    return errors


def random_searches(
    train: DataFrame, features: Features, label: str, key: str, spaces: Mapping[str, tuple[Mapping[str, Sequence], int]], folds: int = 3, seed: int = 42
) -> tuple[DataFrame, dict[str, dict]]:
    """Random draws from several spaces (name -> space, number of draws) over shared folds: their errors, and each space's best."""
    picked = [(name, i, s) for name, (space, draws) in spaces.items() for i, s in enumerate(drawn_settings(space, draws, seed))]
    errors = fold_errors(train, features, label, key, [s for *_, s in picked], folds, seed)
    rows = [(name, i, str(sorted(s.items())), e) for (name, i, s), e in zip(picked, errors)]
    table = train.sparkSession.createDataFrame(rows, "space string, draw int, setting string, cv_rmse double")
    best = {}
    for (name, _, s), e in sorted(zip(picked, errors), key=lambda x: x[1]):
        best.setdefault(name, s)
    return table, best


def random_search(
    train: DataFrame,
    features: Features,
    label: str,
    key: str,
    space: Mapping[str, Sequence] = SCORE_SPACE,
    draws: int = 5,
    folds: int = 3,
    seed: int = 42,
) -> tuple[DataFrame, dict, PipelineModel]:
    """Random draws from a space, scored by RMSE over folds of hashed keys; the best is refitted."""
    table, best = random_searches(train, features, label, key, {"": (space, draws)}, folds, seed)
    final = fit_shared(train, {"best": recipe(features, forest(label, seed, **best[""]))})
    return table.drop("space"), best[""], final["best"]


def capped_forests(
    df: DataFrame, features: Features, label: str, held: Column, caps: Mapping[str, float | None], settings: Mapping | None = None, seed: int = 42
) -> DataFrame:
    """Test errors of a forest under each target cap (a quantile, or None for all rows), from one set of bins.

    A cap keeps rows with 0 < target <= bound, as `cap_rows` does; it is a mask over bands of the target. Fills and
    categories are fitted on all training rows with a positive target. Columns: target_filter, upper_bound, n_rows, largest, mae, rmse, r2.
    """
    rows = df.where(F.col(label) > 0)
    shares = {name: q for name, q in caps.items() if q is not None and q < 1}
    found = quantiles(df, {name: (label, q) for name, q in shares.items()}).first().asDict() if shares else {}
    bounds = {name: found.get(name) for name in caps}
    order = sorted(caps, key=lambda n: float("inf") if bounds[n] is None else bounds[n])
    band = F.lit(0)
    for name in order[:-1]:
        band = band + (F.col(label) > F.lit(bounds[name])).cast("int")
    if bounds[order[-1]] is not None:
        rows = rows.where(F.col(label) <= F.lit(bounds[order[-1]]))
    data = binned_rows(rows, features, label, 2 * band + held.cast("int"), ~held)
    grown = forest(label, seed, **(settings or {})).growth()
    forests = [replace(grown, parts=tuple(2 * b for b in range(i + 1))) for i in range(len(order))]
    scored = written(T.held_out(data, forests, [[grown.trees]] * len(order), [2 * b + 1 for b in range(len(order))]), "capped")
    out = None
    for i, name in enumerate(order):
        size = data.table.where(F.col("part") < 2 * (i + 1)).agg(F.count("*").alias("n_rows"), F.max("y").alias("largest"))
        mine = scored.where(F.col("part") < 2 * (i + 1)).select(F.col("y").alias(label), F.col("means")[i].alias("pred_forest"))
        errors = settled_metrics(mine, label, ["forest"], with_range=False).select("mae", "rmse", "r2")
        row = size.select(F.lit(name).alias("target_filter"), F.lit(bounds[name]).cast("double").alias("upper_bound"), "*").crossJoin(errors)
        out = row if out is None else out.unionByName(row)
    return out


def with_tuned(
    metrics: DataFrame, model: PipelineModel, test: DataFrame, label: str, name: str = "tuned_forest", clip_at_zero: bool = True
) -> DataFrame:
    """The comparison of `compare_models` with one more row for a tuned model, scored on the same test rows."""
    row = settled_metrics(predict_all(test, {name: model}, clip_at_zero), label, [name])
    return metrics.unionByName(row).orderBy("rmse", "mae")


def cap_sensitivity(
    df: DataFrame,
    target: str,
    caps: Mapping[str, float | None],
    fit: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows kept under each target cap; with `fit`, also the metrics row it returns for those rows."""
    from tabkit.operators.clean import cap_rows

    spark, out = df.sparkSession, None
    for name, q in caps.items():
        kept, bound = cap_rows(df, target, q)
        row = kept.agg(F.count(F.lit(1)).alias("n_rows"), F.max(target).alias("largest")).select(
            F.lit(name).alias("target_filter"), F.lit(bound).cast("double").alias("upper_bound"), "n_rows", "largest"
        )
        if fit is not None:
            found = fit(kept).select("mae", "rmse", "r2").first().asDict()
            row = row.withColumns({k: F.lit(v) for k, v in found.items()})
        out = row if out is None else out.unionByName(row)
    return out
