"""The registered queries run to their end, with the library's full settings.

Forests are asked for at full size, which is recorded, and then grown with two trees, so that every query's whole path runs.
The queries with SQL (`full_forest`, `settings_on_levels`, `full_boosting`, `tuned_comparison`) fit at full size.
"""

from dataclasses import replace

import pytest

import __spark_entry__ as entry
from tabkit.operators import boosting as B
from tabkit.operators import lloyd as L
from tabkit.operators import models as M
from tabkit.operators import trees as T


@pytest.fixture
def asked(monkeypatch):
    """Forests that a query asks for; they are grown with two trees."""
    seen = []
    grow, held = T.grow_forests, T.held_out

    def few(data, forests, *rest):
        seen.extend(forests)
        return grow(data, [replace(g, trees=2) for g in forests], *rest)

    def few_held(data, forests, marks, parts, *rest):
        seen.extend(replace(g, trees=m) for g, own in zip(forests, marks) for m in own)
        return held(data, [replace(g, trees=2) for g in forests], [[2] * len(m) for m in marks], parts, *rest)

    monkeypatch.setattr(T, "grow_forests", few)
    monkeypatch.setattr(T, "held_out", few_held)
    return seen


FULL = M.forest("y").growth()


@pytest.mark.parametrize(
    "name, forests, rows",
    [("model_comparison", 1, 5), ("feature_effects", 1, None), ("tree_statistics", 1, 1), ("forest_permutation", 1, 4),
     ("cap_sensitivity_of_fit", 3, 3), ("scenario_metrics", 6, 23), ("scenario_reports", 1, None), ("scenario_tracks", 2, 2)],
)
def test_forests_are_asked_for_at_full_size(spark, sf, asked, name, forests, rows):
    found = entry.queries()[name](spark, sf).collect()
    assert len(found) == rows if rows else len(found) > 5
    assert len(asked) == forests
    for g in asked:
        assert replace(g, columns=None, parts=None) == FULL and g.trees == 300 and g.depth == 30
    if name == "scenario_metrics":
        assert len({g.columns for g in asked}) == 4 and {r["model"] for r in found} == {"category_mean", "linear", "ridge", "forest"}


def test_tuning_covers_all_settings(spark, sf, asked):
    found = entry.queries()["validation_tuning"](spark, sf).collect()
    assert {r["model"] for r in found} == set(M.FOREST_SETTINGS) and sum(r["selected"] for r in found) == 1
    tried = asked[:-1]  # the last one is the refit
    assert sorted(g.trees for g in tried) == sorted(s["numTrees"] for s in M.FOREST_SETTINGS.values())
    assert len({replace(g, trees=0) for g in tried}) == 5


def test_search_covers_both_spaces(spark, sf, asked):
    found = entry.queries()["random_search"](spark, sf).collect()
    assert [r["space"] for r in found] == ["score"] * 5 + ["emission"] * 8 and all(r["cv_rmse"] > 0 for r in found)
    drawn = M.drawn_settings(M.SCORE_SPACE, 5, 42) + M.drawn_settings(M.EMISSION_SPACE, 8, 42)
    for fold in range(3):
        assert {g.trees for g in asked[fold * len(asked) // 3 : (fold + 1) * len(asked) // 3]} == {s["numTrees"] for s in drawn}


def test_boosting_is_asked_for_at_full_size(spark, sf, monkeypatch):
    seen, real = [], B.boost

    def few(data, p, start, **rest):
        seen.append(p)
        return real(data, replace(p, rounds=2), start, **rest)

    monkeypatch.setattr(B, "boost", few)
    assert entry.queries()["full_boosting"](spark, sf).count() == 1
    assert seen == [B.Boosting(300, 6, 0.05, 1.0, 1.0, 1.0, 1.0, 42)]
    plain = M.boosted_unpenalised("y")
    assert (plain.getMaxIter(), plain.getMaxDepth(), plain.getStepSize(), plain.getSubsamplingRate()) == (300, 6, 0.05, 0.8)


@pytest.mark.parametrize("name, sets", [("kmeans_sweep", 900), ("segmentation", 20), ("segments_by_vintage", 20)])
def test_clusters_use_all_starts(spark, sf, monkeypatch, name, sets):
    seen, real = [], L.many_kmeans

    def few(table, wanted, *rest, **named):
        seen.append(wanted)
        return real(table, wanted, *rest, **(named | {"rounds": 2}))

    monkeypatch.setattr(L, "many_kmeans", few)
    found = entry.queries()[name](spark, sf).collect()
    assert len(seen) == 1 and len(seen[0]) == sets
    assert len(found) == (9 if name == "kmeans_sweep" else 3)
    if name == "kmeans_sweep":
        assert {k: list(seen[0].values()).count(k) for k in range(2, 11)} == dict.fromkeys(range(2, 11), 100)
