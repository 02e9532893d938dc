"""Reading, writing, saving, loading and scoring, batch and stream."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tabkit.functions.coerce import placeholder_to_null, to_number
from tabkit.operators import models as M
from tabkit.operators.clean import upper_bound
from tabkit.operators.stages import CategoryMeanRegressor
from tabkit.plans.disclosure import sample_input
from tabkit.plans.registry import query, rounded, table
from tabkit.session import scratch_path
from tabkit.sources import artefacts, tables
from tabkit.streaming.score import read_arriving, score_stream

_BY_TYPE = """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, CAST(sum(user_id) AS BIGINT) AS users
FROM (SELECT nullif(event_type, 'error') AS event_type, value, user_id FROM events) GROUP BY 1
"""


@query(_BY_TYPE)
def csv_round_trip(spark, sf):
    """Raw CSV -> placeholder removed, numbers coerced -> cleaned Parquet -> report."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string"))
    raw = tables.write_csv(events, scratch_path(spark, "events-csv"))
    text = placeholder_to_null(tables.read_csv(spark, raw, events.columns), "error")
    cleaned = text.withColumns({"value": to_number("value"), "user_id": to_number("user_id").cast("long")})
    back = spark.read.parquet(tables.write_table(cleaned, scratch_path(spark, "events-clean")))
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"), F.sum("user_id").alias("users")
    )


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, 'clerk,year_built' AS absent
FROM orders GROUP BY 1
""")
def checked_load(spark, sf):
    """Header-only schema, required target, optional columns reported, unread columns pruned."""
    raw = tables.write_csv(
        table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string")),
        scratch_path(spark, "orders-csv"),
    )
    df, absent = tables.checked_load(
        spark, raw, ["o_totalprice"], ["o_orderstatus", "clerk"], ["o_totalprice", "year_built"]
    )
    kept = tables.keep_columns(df, lambda c: c.startswith("o_"))
    return kept.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum("o_totalprice"), 2).alias("total"),
        F.lit(",".join(absent)).alias("absent"),
    )


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate) = 1999 GROUP BY 1
""")
def year_partitions(spark, sf):
    """Cleaned table partitioned by year: the holdout filter reads one folder."""
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    path = tables.write_table(orders, scratch_path(spark, "orders-by-year"), by=["year"])
    kept = spark.read.parquet(path).where(F.col("year") == 1999)
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


_MEANS = """
WITH r AS (SELECT event_id, nullif(event_type, 'error') AS t, value, event_id % 5 = 0 AS held FROM events),
m AS (SELECT coalesce(t, 'Missing') AS t, avg(value) AS p FROM r WHERE NOT held AND coalesce(t, '') <> 'view' GROUP BY 1),
g AS (SELECT avg(value) AS p FROM r WHERE NOT held AND coalesce(t, '') <> 'view')
SELECT event_id, round(coalesce(m.p, g.p), 6) AS prediction
FROM r LEFT JOIN m ON m.t = coalesce(r.t, 'Missing'), g WHERE held
"""


def _type_mean(spark, sf):
    events = table(spark, sf, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    held = F.pmod("event_id", F.lit(5)) == 0
    seen = F.coalesce(F.col("event_type"), F.lit("")) != "view"
    model = Pipeline(stages=[CategoryMeanRegressor(categoryCol="event_type", labelCol="value")])
    return model.fit(events.where(~held & seen)), events.where(held)


@query(_MEANS)
def save_load_score(spark, sf):
    """A pipeline with a table-backed stage is saved, loaded and scores the held-out rows."""
    model, held = _type_mean(spark, sf)
    path = artefacts.save_model(spark, model, scratch_path(spark, "type-mean"), {"model_name": "category_mean"})
    loaded, _ = artefacts.load_model(spark, path)
    return artefacts.score(loaded, held).select("event_id", rounded("prediction", 6).alias("prediction"))


@query(_MEANS)
def stream_score(spark, sf):
    """The same rows arrive as files and are scored as a stream into an append-only table."""
    model, held = _type_mean(spark, sf)
    arriving = held.select("event_id", "event_type")
    source = scratch_path(spark, "arriving")
    arriving.repartition(4).write.parquet(source)
    out = scratch_path(spark, "scored")
    stream = read_arriving(spark, source, arriving.schema, max_files=2)
    run = score_stream(stream, model, out, scratch_path(spark, "stream-state"))
    run.awaitTermination()
    return spark.read.parquet(out).select("event_id", rounded("prediction", 6).alias("prediction"))


@query("""
SELECT 'category_mean' AS model_name, 'value' AS target, count(*) FILTER (WHERE event_id % 5 <> 0) AS train_rows,
       count(*) FILTER (WHERE event_id % 5 = 0) AS test_rows,
       round(quantile_cont(value, 0.99) FILTER (WHERE event_id % 5 <> 0), 4) AS scope_upper FROM events
""")
def metadata_sidecar(spark, sf):
    """Facts about a fit, written as one JSON line and read back."""
    events = table(spark, sf, "events")
    held = F.pmod("event_id", F.lit(5)) == 0
    sizes = events.agg(F.count_if(~held).alias("train"), F.count_if(held).alias("test")).first()
    about = {
        "model_name": "category_mean",
        "target": "value",
        "train_rows": sizes["train"],
        "test_rows": sizes["test"],
        "scope_upper": round(upper_bound(events.where(~held), "value", 0.99), 4),
    }
    path = tables.write_sidecar(spark, scratch_path(spark, "about"), about)
    schema = "model_name string, target string, train_rows long, test_rows long, scope_upper double"
    return spark.read.schema(schema).json(path)


@query()
def artefact_size(spark, sf):
    """Files and bytes of a saved forest fitted on the whole event table."""
    events = table(spark, sf, "events").withColumn("user", F.col("user_id").cast("double"))
    features = M.Features(["user"], ["event_type"], min_category_count=1)
    model = M.recipe(features, M.forest("value", numTrees=5, maxDepth=4)).fit(events)
    path = artefacts.save_model(spark, model, scratch_path(spark, "forest"))
    return tables.size_on_disk(spark, path)


@query("""SELECT 0.0::DOUBLE AS "user", 'view' AS event_type, round(avg(value), 6) AS prediction FROM events WHERE event_type = 'view' AND user_id % 4 = 0""")
def score_typed_row(spark, sf):
    """A row typed into a form, scored by a saved forest that was fitted on the event table: the mean of its user group and type."""
    events = table(spark, sf, "events").withColumn("user", F.pmod("user_id", F.lit(4)).cast("double"))
    features = M.Features(["user"], ["event_type"], min_category_count=1)
    model = M.recipe(features, M.forest("value", numTrees=3, bootstrap=False, minInstancesPerNode=1)).fit(events)
    path = artefacts.save_model(spark, model, scratch_path(spark, "forest"))
    loaded, _ = artefacts.load_model(spark, path)
    typed = sample_input(spark, {"user": 0.0, "event_type": "view"})
    return artefacts.score(loaded, typed).withColumn("prediction", rounded("prediction", 6))
