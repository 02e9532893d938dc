"""The stages one after the other, and each against the operator's own result."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tabkit.llm import minhash, queries
from tabkit.session import written


def test_stages_on_the_smallest_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    for name, stage in P.STAGES:
        before = docs
        docs = written(stage(spark, before, sf), name)
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near_dedup":
            groups = minhash.near_duplicates(before).where("kept").select("doc_id")
            assert Counter(r[0] for r in docs.select("doc_id").collect()) == Counter(r[0] for r in groups.collect())
        if name == "packing":
            assert Counter(r[0] for r in docs.select("doc_id").distinct().collect()) == Counter(
                r[0] for r in before.select("doc_id").distinct().collect()
            )


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_stage_on_odd_and_empty_tables(spark, sf, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (3, "word word", "en", "a", 9, 1), (3, "word word", "en", "a", 9, 1),
            (None, "some more words", None, "b", 1, 2)]
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, sf)
    assert got.count() >= 0
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_dedup_keeps_one_row_of_repeated_ids(spark, sf):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(3, text), (3, text), (5, text), (None, text), (9, "other words here")], "doc_id long, text string")
    got = P.drop_near_duplicates(spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in got) == {3: 1, None: 1, 9: 1}


def test_near_dedup_keeps_every_text_of_an_id(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (4, b), (4, c), (4, c + " more"), (4, c), (6, ""), (6, "!"), (6, "!"), (7, None), (7, None), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, P.drop_near_duplicates(spark, docs, sf).collect()))
    near = [got.pop((4, t), 0) for t in (c, c + " more")]
    assert sorted(near) == [0, 1]
    assert got == {(1, a): 1, (2, b): 1, (6, ""): 1, (6, "!"): 1, (7, None): 1, (None, c): 1}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLES[name])
    head = [d[0] for d in found.description]
    assert sorted(head) == sorted(frame.columns)
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, frame.select(*head).collect()), key=order) == sorted(found.fetchall(), key=order)
