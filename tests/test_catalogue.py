"""Registered queries beside their SQL. TABKIT_ALL=1 checks every one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabkit.plans.registry import ORACLES

SOME = (
    "subgroup_errors_with_missing subgroup_reports band_errors_wide category_errors model_metrics win_and_tie "
    "best_per_split crosstab_share describe_numeric column_profile duplicate_rows box_stats histogram deciles "
    "size_bins_of_ties numeric_coercion_lenient domain_rules cap_sensitivity engineered_features group_median_fill "
    "rare_groups one_hot entity_holdout scope_filter ridge_single permutation_importance adjusted_rand assign_clusters "
    "save_load_score stream_score metadata_sidecar boosted_stump full_boosting settings_on_levels full_forest near_reconstruction "
    "score_typed_row planted_sweep feature_scenarios"
).split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def order(row):
    return tuple((v is None, str(type(v)), 0 if v is None else round(v, 3) if isinstance(v, float) else v) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4)
    return a == b


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TABKIT_ALL") else SOME)
def test_query_matches_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    found = db.execute(entry.oracle_sql()[name])
    head = [d[0] for d in found.description]
    assert sorted(head) == columns
    theirs = sorted((tuple(dict(zip(head, r))[c] for c in columns) for r in found.fetchall()), key=order)
    assert len(ours) == len(theirs) and ours
    assert all(same(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
