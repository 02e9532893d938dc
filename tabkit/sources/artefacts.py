"""Fitted pipelines with their metadata, saved to and loaded from any shared path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.sources.tables import read_sidecar, write_sidecar


def save_model(spark: SparkSession, model: PipelineModel, path: str, about: Mapping | None = None) -> str:
    model.write().overwrite().save(f"{path}/model")
    write_sidecar(spark, f"{path}/about", dict(about or {}))
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), read_sidecar(spark, f"{path}/about")


def score(model: PipelineModel, df: DataFrame, out: str = "prediction", clip_at_zero: bool = False) -> DataFrame:
    """Input columns plus the prediction. Works on batch and streaming frames alike."""
    scored = model.transform(df)
    value = F.greatest(F.col("prediction"), F.lit(0.0)) if clip_at_zero else F.col("prediction")
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(out))
