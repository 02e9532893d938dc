"""Scoring of arriving rows with a saved pipeline: stateless, append, restartable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabkit.sources.artefacts import score


def read_arriving(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None, kind: str = "parquet"
) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(
    stream: DataFrame,
    model: PipelineModel | Callable[[DataFrame], DataFrame],
    out_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append scored rows to Parquet; offsets live in `checkpoint`, so a restart repeats nothing."""
    scored = model(stream) if callable(model) else score(model, stream)
    writer = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
