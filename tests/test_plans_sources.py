import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabkit.plans import disclosure as D
from tabkit.plans import regression as R
from tabkit.plans import segments as S
from tabkit.session import scratch_path
from tabkit.sources import artefacts, tables
from tabkit.streaming.score import read_arriving, score_stream


@pytest.fixture(scope="module")
def raw_csv(spark):
    """A disclosure file: 160 buildings over three years, with placeholders, commas and bad values."""
    rng = np.random.default_rng(11)
    rows = []
    for b in range(160):
        for year in (2022, 2023, 2024):
            area = int(rng.integers(20_000, 400_000))
            power, gas = rng.uniform(10, 60, 2)
            kind = ["Office", "Hotel", 'Multi "family"\nhousing'][b % 3]
            row = {
                D.YEAR: year,
                "Property ID": b if b % 9 else "Not Available",
                "NYC Building Identification Number (BIN)": f"bin{b}" if b % 27 else None,
                D.YEAR_BUILT: 1700 if b == 5 else 1900 + b % 100,
                D.BUILDINGS: 0 if b == 6 else 1,
                D.OCCUPANCY: 120 if b == 7 else 95,
                D.AREA: f"{area:,}",
                D.LARGEST_AREA: int(area * 0.9),
                D.PRIMARY_TYPE: kind if b % 11 else "Not Available",
                D.LARGEST_TYPE: kind,
                D.EMISSIONS: "Not Available" if b == 8 else round((power + gas) / 10 + b % 3, 4),
                D.WATER: int(area / 20 + rng.integers(0, 500)),
                D.SITE_USE: round(power + gas, 2),
            }
            for i, fuel in enumerate(D.FUELS):
                row[fuel] = [power * area, gas * area][i] if i < 2 else "Not Available"
            rows.append(row)
    path = scratch_path(spark, "raw")
    frame = pd.DataFrame(rows).astype("string")
    tables.write_csv(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns)), path)
    return path


@pytest.fixture(scope="module")
def cleaned(spark, raw_csv):
    df = tables.read_csv(spark, raw_csv, multiline=True)
    path = scratch_path(spark, "cleaned")
    tables.write_csv(D.placeholder_to_null(df), path)
    return path


@pytest.fixture(scope="module")
def engineered(spark, cleaned):
    columns = [D.EMISSIONS, *D.Layout().texts, *D.Layout().numbers]
    df, absent = tables.checked_columns(
        tables.read_csv(spark, cleaned, multiline=True), [D.EMISSIONS], D.Layout().texts, D.Layout().numbers
    )
    assert set(absent) == {"NYC Borough, Block and Lot (BBL)"} and columns
    frame, kinds = D.engineer(D.clean_anomalies(df))
    return D.modelling_rows(frame).persist(), kinds


def test_csv_keeps_quotes_and_line_breaks(spark, raw_csv):
    df = tables.read_csv(spark, raw_csv, multiline=True)
    assert df.count() == 480
    assert {t for _, t in df.dtypes} == {"string"}
    assert 'Multi "family"\nhousing' in {r[0] for r in df.select(f"`{D.LARGEST_TYPE}`").distinct().collect()}


def test_checked_load_guards(spark, raw_csv):
    with pytest.raises(FileNotFoundError):
        tables.checked_load(spark, "/tmp/never/there.csv", ["a"], [], ["a"])
    with pytest.raises(KeyError):
        tables.checked_load(spark, raw_csv, ["No Such Target"], [], [])


def test_shared_cleaning_writes_a_table(spark, raw_csv):
    path = scratch_path(spark, "simple")
    simple = spark.createDataFrame([("Not Available", "1,900"), ("a", "x")], "`City` string, `Year Built` string")
    out = D.shared_cleaning(spark, tables.write_csv(simple, path), scratch_path(spark, "shared"))
    got = spark.read.parquet(out)
    assert dict(got.dtypes)["Year Built"] == "double"
    assert sorted((r["City"] or "", r["Year Built"] or 0) for r in got.collect()) == [("", 1900.0), ("a", 0)]


def test_engineering(engineered):
    rows, kinds = engineered
    sets = D.scenarios(kinds)
    sizes = {k: (len(f.numeric), len(f.categorical)) for k, f in sets.items()}
    assert sizes == {
        "estimation_full": (42, 1), "estimation_without_intensities": (30, 1),
        "forecasting_strict": (6, 1), "fuel_derived_only": (36, 0),
    }
    assert rows.count() == 477
    assert rows.where(F.col(D.BUILDING_ID).startswith("row_")).select(D.BUILDING_ID).distinct().count() == 6 * 3
    got = rows.agg(
        F.sum("district_steam_missing"), F.sum("district_steam_intensity"), F.max(F.abs(F.col("electricity_grid_purchase_share") + F.col("natural_gas_share") - 1)),
        F.count(f"`{D.YEAR_BUILT}`"), F.count(f"`{D.OCCUPANCY}`"), F.count(f"`{D.BUILDINGS}`"),
    ).first()
    assert got[0] == 477 and got[1] == 0.0 and got[2] < 1e-12 and tuple(got[3:]) == (474, 474, 474)


def test_scenario_runs_and_artefact(spark, engineered):
    rows, kinds = engineered
    sets = D.scenarios(kinds)
    rows = rows.withColumn("id", F.xxhash64(D.BUILDING_ID, D.YEAR))
    small = {"numTrees": 5, "maxDepth": 5}
    full = R.run_split(rows, "estimation_full", sets["estimation_full"], D.EMISSIONS, "year", year=D.YEAR, holdout=2024, category=D.MODEL_TYPE, forest_settings=small)
    strict = R.run_split(rows, "forecasting_strict", sets["forecasting_strict"], D.EMISSIONS, "group", entity=D.BUILDING_ID, key="id", category=D.MODEL_TYPE, forest_settings=small)
    metrics = R.all_metrics([full, strict])
    by = {(r["scenario"], r["model"]): r["rmse"] for r in metrics.collect()}
    assert by[("estimation_full", "linear")] < by[("forecasting_strict", "linear")]
    assert set(r["scenario_label"] for r in metrics.collect()) == {"Estimation Full", "Forecasting (Metadata Only)"}
    best = R.best_learned(full)
    assert best not in R.BASELINES
    counts = R.dataset_counts(full).first()
    assert counts["raw_columns"] == 43 and counts["train_rows"] + counts["train_rows_removed"] == 318
    frame = R.prediction_frame(full, best, D.EMISSIONS, "id", D.MODEL_AREA)
    report = R.reports(frame, D.MODEL_TYPE, D.YEAR, min_count=1)
    assert report.groupBy("report").agg(F.sum("n").alias("n")).select("n").distinct().count() == 1
    about = R.artefact_metadata(full, best, D.EMISSIONS, 2024)
    path = artefacts.save_model(spark, full.models[best], scratch_path(spark, "best"), about)
    model, read = artefacts.load_model(spark, path)
    assert read["model_name"] == best and read["holdout_year"] == 2024
    assert tables.size_on_disk(spark, path).first()["n_bytes"] > 0
    test = rows.where(F.col(D.YEAR) == 2024).drop("id")
    one = artefacts.score(model, test, clip_at_zero=True)
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    test.repartition(3).write.parquet(source)
    stream = read_arriving(spark, source, test.schema, max_files=1)
    state = scratch_path(spark, "state")
    for _ in range(2):  # a restart from the same state adds nothing
        score_stream(stream, lambda d: artefacts.score(model, d, clip_at_zero=True), out, state).awaitTermination()
    two = spark.read.parquet(out)
    assert two.count() == test.count()
    total = lambda d: d.agg(F.sum("prediction")).first()[0]
    assert total(two) == pytest.approx(total(one))


def test_near_reconstruction(engineered):
    rows, kinds = engineered
    fuels = [c for c, kind in kinds.items() if kind == "intensity"][:2]
    types = rows.where(F.col(D.MODEL_TYPE) == "Office")
    metrics, coefficients = R.near_reconstruction(types.where(F.col(D.YEAR) < 2024), types.where(F.col(D.YEAR) == 2024), fuels, D.EMISSIONS)
    assert metrics.first()["r2"] > 0.99
    assert [r["coefficient"] for r in coefficients.collect()] == pytest.approx([0.1, 0.1], rel=0.05)


def test_segmentation_and_assignment(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        energy, water = [(300, 2), (120, 9), (40, 1)][i % 3]
        rows.append((2024, energy + rng.normal() * 5, (water + rng.random()) * 100, 100.0, "Office" if i % 5 else None, 1930.0 + i % 90))
    rows += [(2024, -1.0, 5.0, 1.0, "x", 2000.0), (2023, 1.0, 1.0, 1.0, "x", 2000.0)]
    df = spark.createDataFrame(rows, "y int, e double, w double, a double, t string, b double")
    columns = S.Columns("y", "e", "w", "a", "t", "b")
    prepared = S.with_bins(S.prepare(df, columns, 2024), columns)
    assert prepared.count() == 300
    model, labelled, centres = S.segment(prepared, k=3, starts=4)
    sizes = {r["cluster_name"]: r["n"] for r in S.profile(labelled, centres, "a").collect()}
    assert sizes == {"High Energy - Moderate Water": 100, "Moderate Energy - Higher Water": 100, "Low Energy - Low Water": 100}
    path = artefacts.save_model(spark, model, scratch_path(spark, "segments"), S.artefact(model, centres, 3))
    loaded, about = artefacts.load_model(spark, path)
    fresh = spark.createDataFrame([(1, 310.0, 250.0, 100.0), (2, 5.0, 1.0, 100.0), (3, 1.0, 1.0, 0.0)], "id int, e double, w double, a double")
    got = {r["id"]: r["cluster_name"] for r in S.assign(fresh, loaded, about["cluster_names"], columns).collect()}
    assert got == {1: "High Energy - Moderate Water", 2: "Low Energy - Low Water", 3: None}


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    from tabkit.sources.tables import read_csv

    folder = tmp_path / "yearly"
    folder.mkdir()
    (folder / "a.csv").write_text("year,area\n2021,7\n")
    (folder / "b.csv").write_text("year,area\n2022,8\n")
    assert sorted(map(tuple, read_csv(spark, str(folder)).collect())) == [("2021", "7"), ("2022", "8")]
    (folder / "b.csv").write_text("area,year\n8,2022\n")
    with pytest.raises(Exception, match="does not conform"):
        read_csv(spark, str(folder)).collect()
