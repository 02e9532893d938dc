import math

import pytest
from pyspark.sql import functions as F

from tabkit import session
from tabkit.functions import bands, coerce, names, numbers
from tabkit.operators import ranks


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.fixture(scope="module")
def messy(spark):
    texts = ["1,200", " 12 ", "12d", "12f", "1e5 kWh", "Not Available", "nan", "inf", "", "1-2", None, ".5", "-3e2", "1_000"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)


def test_to_number(messy):
    got = values(messy.select("i", coerce.to_number("s").alias("x")).orderBy("i"), "x")
    assert got == [1200.0, 12.0, None, None, None, None, None, None, None, None, None, 0.5, -300.0, None]


def test_to_number_lenient(messy):
    got = values(messy.select("i", coerce.to_number_lenient("s").alias("x")).orderBy("i"), "x")
    assert got == [1200.0, 12.0, 12.0, 12.0, 15.0, None, None, None, None, None, None, 0.5, -32.0, 1000.0]


def test_placeholder_and_nan(spark):
    df = spark.createDataFrame([("Not Available", float("nan")), ("a", 1.0), (None, None)], "s string, x double")
    got = coerce.placeholder_to_null(df).withColumn("x", coerce.nan_to_null("x"))
    assert values(got, "s", "x") == [(None, None), ("a", 1.0), (None, None)]


def test_ratios_and_sums(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (4.0, 2.0)], "a double, b double")
    out = df.select(
        numbers.ratio("a", "b").alias("r"),
        numbers.ratio_or_zero("a", "b").alias("z"),
        numbers.row_sum(["a", "b"]).alias("s"),
        numbers.missing_flag("a").alias("m"),
    )
    assert values(out, "r") == [None, None, None, None, 2.0]
    assert values(out, "z") == [0.0, 0.0, 0.0, 0.0, 2.0]
    assert values(out, "s") == [1.0, 0.0, 1.0, 1.0, 6.0]
    assert values(out, "m") == [0, 0, 1, 0, 0]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (9.0,), (None,)], "x double")
    assert values(df.select(numbers.clip("x", 0.0, 1.0).alias("c")), "c") == [0.0, 0.5, 1.0, None]
    assert values(df.select(numbers.clip("x", low=0.0).alias("c")), "c") == [0.0, 0.5, 9.0, None]


def test_skew_is_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert df.agg(numbers.skew("x")).first()[0] == pytest.approx(1.763632614803888)
    assert df.limit(2).agg(numbers.skew("x")).first()[0] is None


def test_r2_without_spread(spark):
    df = spark.createDataFrame([(5.0, 5.0, 4.0)] * 3, "y double, good double, bad double")
    row = df.agg(numbers.r2("y", "good").alias("a"), numbers.r2("y", "bad").alias("b")).first()
    assert (row["a"], row["b"]) == (1.0, 0.0)


def test_band_edges(spark):
    xs = [-1.0, 0.0, 25.0, 25.1, 50.0, 100.0, 101.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = values(df.select(bands.fixed_bands("x", bands.SCORE_EDGES, bands.SCORE_LABELS).alias("b")), "b")
    assert got == [None, "1-25", "1-25", "26-50", "26-50", "76-100", None, None]
    got = values(df.select(bands.fixed_bands("x", bands.VINTAGE_EDGES, bands.VINTAGE_LABELS).alias("b")), "b")
    assert got == ["Pre-1940"] * 7 + [None]
    with pytest.raises(ValueError):
        bands.fixed_bands("x", [0, 1], ["a", "b"])


def test_quantile_bands_with_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 6 + [(2.0,), (None,)], "x double")
    got = values(bands.quantile_bands(df, "x", "b"), "b")
    assert got == ["Small"] * 6 + ["Very Large", None]


def test_slugs(spark):
    wanted = {
        "Electricity Use - Grid Purchase (kBtu)": "electricity_grid_purchase",
        "Fuel Oil #5 & 6 Use (kBtu)": "fuel_oil_5_6",
        "Natural Gas Use (kBtu)": "natural_gas",
    }
    df = spark.createDataFrame([(k,) for k in wanted], "s string")
    assert [names.slug(k) for k in wanted] == list(wanted.values())
    assert values(df.select(names.slug_column("s").alias("t")), "t") == list(wanted.values())


def test_stable_id_survives_repartitioning(spark):
    df = spark.createDataFrame(
        [(None, "b1", 1), ("nan", None, 2), (None, None, 3), (None, None, 4), ("p", "b", 5)], "p string, b string, v int"
    )
    one = dict(values(df.select("v", names.stable_id(df, ["p", "b"]).alias("id")), "v", "id"))
    many = df.repartition(4)
    two = dict(values(many.select("v", names.stable_id(many, ["p", "b"]).alias("id")), "v", "id"))
    assert one == two
    assert one[1] == "b1" and one[5] == "p" and one[2].startswith("row_")
    assert len({one[2], one[3], one[4]}) == 3


@pytest.mark.parametrize("limit", [0, 20_000])
def test_equal_rows_without_ids_get_ids_of_their_own(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "settle", lambda t: session.settle(t, limit))
    rows = [(None, 1)] * 500 + [("nan", 2)] * 3 + [(None, 3), ("b", 4), ("b", 4)]
    df = spark.createDataFrame(rows, "b string, v int").repartition(5)
    found = ranks.with_row_id(df, ["b", "absent"], "id")
    assert found.columns == ["b", "v", "id"]
    ids = values(found.select("v", "id"), "v", "id")
    assert sorted(v for v, _ in ids) == sorted(v for _, v in rows)
    assert len({i for _, i in ids}) == 505 and [i for v, i in ids if v == 4] == ["b", "b"]
    assert {i for v, i in ids if v <= 2} == {i for _, i in values(ranks.with_row_id(df.coalesce(1), ["b"], "id"), "v", "id") if _ <= 2}


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.375,)], "x double")
    assert values(df.select(numbers.half_even("x", 2).alias("r")), "r") == [0.12, 0.38]
    assert math.isclose(df.select(F.expm1(F.log1p("x")).alias("r")).first()["r"], 0.125)
