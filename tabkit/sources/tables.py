"""Reading and writing tables: disclosure files as text, cleaned tables as Parquet, sidecars as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.coerce import NULL_TOKENS, to_number


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for every file system Spark can read; nothing is read but the listing."""
    try:
        spark.read.text(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool = False
) -> DataFrame:
    """A headered CSV with every column as text: no inference pass, same types in every yearly file.

    Pass `columns` for a fixed schema; otherwise the names come from one file's header line. Files whose header
    differs from it, by order too, are refused when they are read, not read with swapped columns. Quoted line
    breaks need `multiline`, which makes each file one task; leave it off for large files.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    if columns is None:
        columns = reader.option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def keep_columns(df: DataFrame, wanted: Callable[[str], bool] | Iterable[str]) -> DataFrame:
    """Columns accepted by a name test or found in a collection; Catalyst prunes the scan."""
    if callable(wanted):
        test = wanted
    else:
        names = set(wanted)
        test = names.__contains__
    return df.select(*[F.col(f"`{c}`") for c in df.columns if test(c)])


def checked_columns(
    df: DataFrame, required: Sequence[str], texts: Sequence[str], numbers: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Required columns must exist; optional ones that are absent are reported, and numbers are coerced."""
    for c in required:
        if c not in df.columns:
            raise KeyError(f"required column not found: {c}")
    absent = [c for c in (*texts, *numbers) if c not in df.columns]
    chosen = [F.col(f"`{c}`") for c in texts if c in df.columns]
    chosen += [to_number(F.col(f"`{c}`"), NULL_TOKENS).alias(c) for c in numbers if c in df.columns]
    return df.select(*chosen), absent


def checked_load(
    spark: SparkSession, path: str, required: Sequence[str], texts: Sequence[str], numbers: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"missing input: {path}; write the cleaned table first")
    return checked_columns(read_csv(spark, path), required, texts, numbers)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> str:
    """Cleaned table as Parquet, by default unpartitioned; partition by year to prune holdout scans.

    The rebalance hint lets adaptive execution give a large year several writers and small ones one file.
    """
    if by:
        df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_sidecar(spark: SparkSession, path: str, about: Mapping) -> str:
    """Metadata of an artefact as one JSON line."""
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def size_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a path; only the listing is read, not the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
