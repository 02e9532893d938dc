"""Copies, repeated ids and signs that look like letters."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabkit.llm import lang_id, mixing, packing, queries, topk

VEC = "vec_id long, embedding array<double>, query long"


def test_a_language_of_copies_is_learned(spark):
    en = [f"the house number {i} is on the hill" for i in range(50)]
    fr = [f"la maison numéro {i} est sur la colline" for i in range(50)]
    rows = [(t, "en") for t in en] + [(t, "fr") for t in fr] + [("das Haus steht auf dem Hügel", "de")] * 9000
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = lang_id.fit(docs, F.lit(True), sample_rows=40)
    assert model.langs == ["de", "en", "fr"]
    got = {r["text"]: r["lang_pred"] for r in lang_id.identify(docs.distinct(), model, ["text"]).collect()}
    assert got["das Haus steht auf dem Hügel"] == "de" and got[en[3]] == "en" and got[fr[3]] == "fr"


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([("the cat sat", "en"), ("le chat est", "fr")], "text string, lang string")
    model = lang_id.fit(docs, F.lit(True))
    odd = spark.createDataFrame([("² ½ ①",), ("2 ² _",), ("² x",), ("ª",)], "text string")
    got = {r["text"]: r["lang_pred"] for r in lang_id.identify(odd, model, ["text"]).collect()}
    assert got["² ½ ①"] == got["2 ² _"] == "und" and got["² x"] != "und" and got["ª"] != "und"


def test_queries_with_one_id_have_a_list_each(spark):
    rows = [(100, [1.0, 0.0], 0), (100, [0.0, 1.0], 0)] + [(i, [i / 8, 1 - i / 8], 0) for i in range(1, 9)] + [(3, [3 / 8, 5 / 8], 0)]
    for block in (4096, 1):
        found = topk.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") == 100, k=3, scale=8, query_block=block).collect()
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found)
        assert all(r["query_id"] == 100 for r in found)
        assert got == sorted([(1, 8, 64), (2, 7, 56), (3, 6, 48), (1, 1, 56), (2, 2, 48), (3, 3, 40)])


def test_huge_components_are_refused(spark):
    for value, word in ((1e30, "2\\^53"), (3e9, "64-bit")):
        table = spark.createDataFrame([(100, [value, 1.0], 0), (1, [value, 1.0], 0)], VEC)
        with pytest.raises(Exception, match=word):
            topk.top_k(table, F.col("vec_id") == 100).collect()


def test_rows_without_an_id_have_keys_of_their_own(spark):
    """A third of the rows have no id and a third one id: by their texts they spread over slices, and reruns agree."""
    rows = [(i if i % 3 == 0 else None if i % 3 == 1 else 7, f"w{i} w", "a") for i in range(600)]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(data, [1.0], share=0.5, slice_rows=20, keep=["text"]).collect()
    taken = Counter(None if r["doc_id"] is None else r["doc_id"] == 7 for r in got if r["taken"])
    assert sum(r["taken"] for r in got) == 600
    assert all(70 < taken[k] < 130 for k in (None, True, False))
    again = mixing.mix(data.repartition(7), [1.0], share=0.5, slice_rows=50, keep=["text"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    alike = spark.createDataFrame([(None, "w w", "a")] * 100, data.schema)
    same = mixing.mix(alike, [1.0], share=0.5, slice_rows=20).collect()
    assert sorted(r["taken"] for r in same) == [0] * 50 + [2] * 50


def test_repeated_rows_are_packed_in_all_groups(spark):
    rows = [(None, "one two three")] * 300 + [(5, "one two three")] * 300
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(data, queries.vocabulary(), group_rows=100).collect()
    groups = Counter(r["sequence_id"] >> 40 for r in got)
    assert len(got) == 600 and len(groups) == 6 and max(groups.values()) < 150
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(places, places[1:]))
