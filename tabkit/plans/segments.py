"""Segmentation of one year by energy and water intensity, and assignment of new rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.bands import VINTAGE_EDGES, VINTAGE_LABELS, fixed_bands, quantile_bands
from tabkit.functions.numbers import ratio
from tabkit.operators.clean import positive_rows
from tabkit.operators.cluster import best_kmeans, cluster_profile, name_clusters
from tabkit.operators.stages import PopulationScaler, Winsorizer
from tabkit.session import written

FEATURES = ["energy_wins", "log_water_intensity"]


@dataclass(frozen=True)
class Columns:
    year: str
    energy: str
    water: str
    area: str
    category: str
    built: str


def prepare(df: DataFrame, c: Columns, year: int) -> DataFrame:
    """Rows of one year with positive energy, water and area, their water intensity and category."""
    rows = positive_rows(df.where(F.col(c.year) == year), [c.area, c.energy, c.water])
    rows = rows.withColumns(
        {
            "water_intensity": ratio(c.water, c.area),
            "energy_raw": F.col(c.energy).cast("double"),
            "type_clean": F.coalesce(F.col(c.category).cast("string"), F.lit("Unknown")),
        }
    )
    return rows.where(F.col("water_intensity") > 0)


def with_bins(rows: DataFrame, c: Columns) -> DataFrame:
    binned = quantile_bands(rows, c.area, "size_bin")
    return binned.withColumn("vintage_bin", fixed_bands(c.built, VINTAGE_EDGES, VINTAGE_LABELS))


def feature_stages() -> list:
    """Clip at the 1 and 99 percent quantiles, log of the water intensity, population scaling."""
    return [
        Winsorizer(inputCols=["energy_raw", "water_intensity"], outputCols=["energy_wins", "water_wins"]),
        SQLTransformer(statement="SELECT *, log1p(water_wins) AS log_water_intensity FROM __THIS__"),
        PopulationScaler(inputCols=FEATURES, outputCols=["energy_z", "water_z"]),
        VectorAssembler(inputCols=["energy_z", "water_z"], outputCol="features"),
    ]


def segment(rows: DataFrame, k: int = 3, seed: int = 42, starts: int = 20) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fitted pipeline (features and clusters), the labelled rows, and the named centres in original units."""
    prepared = Pipeline(stages=feature_stages()).fit(rows)
    ready = written(prepared.transform(rows), "segment-rows")
    model = best_kmeans(ready, k, seed, starts)
    labelled = model.transform(ready)
    scaler = prepared.stages[2]
    spark = rows.sparkSession
    centres = spark.createDataFrame(
        [(i, float(p[0]), float(p[1])) for i, p in enumerate(model.clusterCenters())],
        "cluster int, energy_z double, water_z double",
    )
    centres = scaler.inverse(centres).select(
        "cluster",
        F.col("energy_z").alias("energy_centre"),
        F.col("water_z").alias("log_water_centre"),
        F.expm1("water_z").alias("water_intensity_centre"),
    )
    named = name_clusters(centres, "cluster", "energy_centre", "log_water_centre")
    return PipelineModel(stages=[*prepared.stages, model]), labelled, named


def profile(labelled: DataFrame, centres: DataFrame, area: str) -> DataFrame:
    return cluster_profile(
        labelled,
        "cluster",
        {"energy_mean": "energy_wins", "water_mean": "water_wins"},
        {"energy_median": "energy_wins", "water_median": "water_wins", "area_median": area},
        centres,
    )


def artefact(model: PipelineModel, centres: DataFrame, k: int) -> dict:
    """What to save beside the pipeline: clip bounds, feature names, cluster names."""
    bounds = model.stages[0]
    lows, highs = bounds.getOrDefault("values"), bounds.getOrDefault("tops")
    names = {str(r["cluster"]): r["cluster_name"] for r in centres.collect()}
    return {
        "final_k": k,
        "energy_lower": lows[0],
        "energy_upper": highs[0],
        "water_lower": lows[1],
        "water_upper": highs[1],
        "feature_names": FEATURES,
        "cluster_names": names,
    }


def assign(df: DataFrame, model: PipelineModel, names: Mapping[str, str], c: Columns) -> DataFrame:
    """Nearest cluster and its name for new rows; "Unknown" for a cluster without a name.

    Rows without energy or water intensity stay, without a cluster.
    """
    rows = df.withColumns(
        {"water_intensity": ratio(c.water, c.area), "energy_raw": F.col(c.energy).cast("double")}
    )
    usable = F.col("water_intensity").isNotNull() & F.col("energy_raw").isNotNull()
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    name = F.coalesce(F.try_element_at(known, F.col("cluster").cast("string")), F.lit("Unknown"))
    kept = [*df.columns, "water_intensity", "cluster", "cluster_name"]
    found = model.transform(rows.where(usable)).withColumn("cluster_name", name).select(*kept)
    return found.unionByName(rows.where(~usable).select(*kept[:-2]), allowMissingColumns=True)
