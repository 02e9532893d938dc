"""Pipeline stages that Spark lacks: exact fills, rare categories, population scaling, simple models.

Each stage is fitted on the training rows only. Fitted state is either a few numbers per column (kept
as params) or a table with one row per category (kept as a DataFrame and saved as Parquet), so the number
of categories is not limited by the driver.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols, HasPredictionCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.numbers import clip
from tabkit.operators.clean import winsor_bounds
from tabkit.operators.quantiles import quantiles
from tabkit.session import join_large, one_row, settle


class _Columns(HasInputCols, HasOutputCols):
    """Input columns and, by default, the same output columns."""

    def _outputs(self) -> list[str]:
        return self.getOutputCols() if self.isDefined("outputCols") else self.getInputCols()


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._hold(self.sparkSession.read.parquet(f"{path}/table"))
        return model


class _TableModel(Model, MLReadable, MLWritable):
    """A model whose fitted state is a table with one row per key."""

    table: DataFrame

    def _hold(self, table: DataFrame) -> _TableModel:
        self.table, self.small = settle(table)
        return self

    def _look_up(self, df: DataFrame, key: str, table: DataFrame) -> DataFrame:
        """Left join on one key: broadcast when the table was proven small, else by shuffle."""
        if self.small:
            return df.join(F.broadcast(table), key, "left")
        return join_large(df, table, [key], weight="__n")

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _WithValues(_Columns):
    values = Param(Params._dummy(), "values", "one fitted number per column", TypeConverters.toListFloat)


# --- filling ---------------------------------------------------------------------------------------


class MedianFill(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Replace missing numbers by the exact median. A column without any value is filled with 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianFillModel:
        columns = self.getInputCols()
        found = one_row(quantiles(df, {str(i): (f"`{c}`", 0.5) for i, c in enumerate(columns)}))
        values = [0.0 if found[str(i)] is None else found[str(i)] for i in range(len(columns))]
        return MedianFillModel()._set(inputCols=columns, outputCols=self._outputs(), values=values)


class MedianFillModel(Model, _WithValues, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        triples = zip(self.getInputCols(), self._outputs(), self.getOrDefault("values"))
        return df.withColumns(
            {o: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(v)) for c, o, v in triples}
        )


class ModeFill(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Replace missing texts by the most frequent one; among equals the smallest."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeFillModel:
        values = []
        for c in self.getInputCols():
            counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).count()
            best = counts.orderBy(F.desc("count"), "v").limit(1).collect()
            values.append(str(best[0]["v"]) if best else "")
        return ModeFillModel()._set(inputCols=self.getInputCols(), outputCols=self._outputs(), values=values)


class ModeFillModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    values = Param(Params._dummy(), "values", "fitted text per column", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        triples = zip(self.getInputCols(), self._outputs(), self.getOrDefault("values"))
        return df.withColumns({o: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, o, v in triples})


class _GroupCol(Params):
    groupCol = Param(Params._dummy(), "groupCol", "category of a row", TypeConverters.toString)


class GroupMedianFill(Estimator, _Columns, _GroupCol, DefaultParamsReadable, DefaultParamsWritable):
    """Replace missing numbers by the median of the row's group, else by the median of all rows."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, groupCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> GroupMedianFillModel:
        columns, group = self.getInputCols(), self.getOrDefault("groupCol")
        wanted = {f"__m{i}": (f"`{c}`", 0.5) for i, c in enumerate(columns)}
        sizes, _ = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")))
        rows = sizes.agg(F.sum("__n")).first()[0] or 0
        overall = one_row(quantiles(df, wanted, known_rows=rows))
        medians = quantiles(df, wanted, by=[group], known_rows=rows)
        model = GroupMedianFillModel()._set(
            inputCols=columns,
            outputCols=self._outputs(),
            groupCol=group,
            values=[overall[f"__m{i}"] or 0.0 for i in range(len(columns))],
        )
        return model._hold(medians.join(sizes, group))


class GroupMedianFillModel(_TableModel, _WithValues, _GroupCol):
    def _transform(self, df: DataFrame) -> DataFrame:
        joined = self._look_up(df, self.getOrDefault("groupCol"), self.table)
        triples = zip(self.getInputCols(), self._outputs(), self.getOrDefault("values"))
        filled = {
            o: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"__m{i}"), F.lit(v))
            for i, (c, o, v) in enumerate(triples)
        }
        extra = [o for o in filled if o not in df.columns]
        return joined.withColumns(filled).select(*[F.col(f"`{c}`") for c in df.columns + extra])


# --- categories ------------------------------------------------------------------------------------


class _Rare(_Columns):
    minCount = Param(Params._dummy(), "minCount", "least rows of a kept category", TypeConverters.toInt)
    otherLabel = Param(Params._dummy(), "otherLabel", "label of rare categories", TypeConverters.toString)
    missingLabel = Param(Params._dummy(), "missingLabel", "label of missing", TypeConverters.toString)


class RareGrouper(Estimator, _Rare, DefaultParamsReadable, DefaultParamsWritable):
    """Keep categories with at least `minCount` training rows; others become "Other", missing "Missing"."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, minCount=200, otherLabel="Other", missingLabel="Missing"):
        super().__init__()
        self._setDefault(minCount=200, otherLabel="Other", missingLabel="Missing")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RareGrouperModel:
        columns = self.getInputCols()
        cells = F.array(
            *[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
        )
        keepers = (
            df.select(F.inline(cells))
            .where("v is not null")
            .groupBy("c", "v")
            .agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") >= self.getOrDefault("minCount"))
        )
        model = RareGrouperModel()._set(
            inputCols=columns,
            outputCols=self._outputs(),
            **{p: self.getOrDefault(p) for p in ("minCount", "otherLabel", "missingLabel")},
        )
        return model._hold(keepers)


class RareGrouperModel(_TableModel, _Rare):
    def _transform(self, df: DataFrame) -> DataFrame:
        other, missing = self.getOrDefault("otherLabel"), self.getOrDefault("missingLabel")
        names = list(df.columns)
        for c, o in zip(self.getInputCols(), self._outputs()):
            keep = self.table.where(F.col("c") == c).select(
                F.col("v").alias("__key"), F.lit(True).alias("__kept"), "__n"
            )
            keyed = df.withColumn("__key", F.col(f"`{c}`").cast("string"))
            joined = self._look_up(keyed, "__key", keep)
            label = (
                F.when(F.col("__key").isNull(), F.lit(missing))
                .when(F.col("__kept"), F.col("__key"))
                .otherwise(F.lit(other))
            )
            df = joined.withColumn(o, label)
            names = names if o in names else [*names, o]
            df = df.select(*[F.col(f"`{n}`") for n in names])
        return df


# --- scaling and clipping --------------------------------------------------------------------------


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population deviation; a constant column is divided by 1."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        columns = self.getInputCols()
        found = one_row(
            df.agg(
                *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
                *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
            )
        )
        size = range(len(columns))
        return PopulationScalerModel()._set(
            inputCols=columns,
            outputCols=self._outputs(),
            values=[found[f"m{i}"] or 0.0 for i in size],
            spreads=[found[f"s{i}"] or 1.0 for i in size],
        )


class PopulationScalerModel(Model, _WithValues, DefaultParamsReadable, DefaultParamsWritable):
    spreads = Param(Params._dummy(), "spreads", "population deviation per column", TypeConverters.toListFloat)

    def _zip(self):
        return zip(self.getInputCols(), self._outputs(), self.getOrDefault("values"), self.getOrDefault("spreads"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {o: (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s) for c, o, m, s in self._zip()}
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        """Scaled columns back to original units."""
        return df.withColumns({o: F.col(f"`{o}`") * F.lit(s) + F.lit(m) for _, o, m, s in self._zip()})


class _Limits(_Columns):
    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)


class Winsorizer(Estimator, _Limits, DefaultParamsReadable, DefaultParamsWritable):
    """Clip columns at quantiles of the training rows; the bounds are saved with the model."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, lower=0.01, upper=0.99):
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> WinsorizerModel:
        columns = self.getInputCols()
        bounds = winsor_bounds(df, columns, self.getOrDefault("lower"), self.getOrDefault("upper"))
        return WinsorizerModel()._set(
            inputCols=columns,
            outputCols=self._outputs(),
            values=[bounds[c][0] for c in columns],
            tops=[bounds[c][1] for c in columns],
        )


class WinsorizerModel(Model, _WithValues, DefaultParamsReadable, DefaultParamsWritable):
    tops = Param(Params._dummy(), "tops", "upper bound per column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = zip(self.getInputCols(), self._outputs(), self.getOrDefault("values"), self.getOrDefault("tops"))
        return df.withColumns({o: clip(F.col(f"`{c}`").cast("double"), lo, hi) for c, o, lo, hi in parts})


# --- simple models ---------------------------------------------------------------------------------


class _Baseline(HasLabelCol, HasPredictionCol):
    categoryCol = Param(Params._dummy(), "categoryCol", "category of a row", TypeConverters.toString)
    fallback = Param(Params._dummy(), "fallback", "mean or median", TypeConverters.toString)
    constant = Param(Params._dummy(), "constant", "prediction for unknown rows", TypeConverters.toFloat)


def _centre(df: DataFrame, label: str, strategy: str) -> float:
    if strategy == "median":
        return one_row(quantiles(df, {"m": (label, 0.5)}))["m"]
    return df.agg(F.avg(label)).first()[0]


class MeanRegressor(Estimator, _Baseline, DefaultParamsReadable, DefaultParamsWritable):
    """Predicts the training mean (or median) for every row."""

    @keyword_only
    def __init__(self, *, labelCol="label", predictionCol="prediction", fallback="mean"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", fallback="mean")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MeanRegressorModel:
        value = _centre(df, self.getLabelCol(), self.getOrDefault("fallback"))
        return MeanRegressorModel()._set(predictionCol=self.getPredictionCol(), constant=value)


class MeanRegressorModel(Model, _Baseline, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), F.lit(self.getOrDefault("constant")))


class CategoryMeanRegressor(Estimator, _Baseline, DefaultParamsReadable, DefaultParamsWritable):
    """Predicts the training mean of the row's category; missing is the category "Missing"."""

    @keyword_only
    def __init__(self, *, categoryCol=None, labelCol="label", predictionCol="prediction", fallback="mean"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", fallback="mean")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CategoryMeanRegressorModel:
        category, label = self.getOrDefault("categoryCol"), self.getLabelCol()
        if category not in df.columns:
            raise KeyError(category)
        key = F.coalesce(F.col(f"`{category}`").cast("string"), F.lit("Missing"))
        means = df.groupBy(key.alias("__key")).agg(F.avg(label).alias("__mean"), F.count(label).alias("__n"))
        model = CategoryMeanRegressorModel()._set(categoryCol=category, predictionCol=self.getPredictionCol())
        model._hold(means)
        if self.getOrDefault("fallback") == "median":
            return model._set(constant=_centre(df, label, "median"))
        # The mean of all rows follows from the means of the categories, without another pass.
        weighted = F.sum(F.col("__mean") * F.col("__n")) / F.sum("__n")
        return model._set(constant=model.table.agg(weighted).first()[0])


class CategoryMeanRegressorModel(_TableModel, _Baseline):
    def _transform(self, df: DataFrame) -> DataFrame:
        category, out = self.getOrDefault("categoryCol"), self.getPredictionCol()
        if category not in df.columns:
            raise KeyError(category)
        keyed = df.withColumn("__key", F.coalesce(F.col(f"`{category}`").cast("string"), F.lit("Missing")))
        joined = self._look_up(keyed, "__key", self.table)
        value = F.coalesce(F.col("__mean"), F.lit(self.getOrDefault("constant")))
        return joined.withColumn(out, value).drop("__key", "__mean", "__n")


class RidgeRegression(Estimator, _Baseline, DefaultParamsReadable, DefaultParamsWritable):
    """Least squares with penalty `alpha` * |coefficients|^2 on the summed squared error.

    Spark divides the error by n and the label by its deviation, so its own penalty is
    alpha * deviation / n.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, alpha=1.0, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(alpha=1.0, featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        label = self.getLabelCol()
        size = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
        spread = size["s"] or 1.0
        return LinearRegression(
            featuresCol=self.getOrDefault("featuresCol"),
            labelCol=label,
            predictionCol=self.getPredictionCol(),
            regParam=self.getOrDefault("alpha") * spread / size["n"],
            elasticNetParam=0.0,
            standardization=False,
        ).fit(df)
