"""Baseline models and their errors, sliced and compared."""

from pyspark.sql import functions as F

from tabkit.functions.bands import USE_EDGES, USE_LABELS, fixed_bands
from tabkit.operators import evaluate as E
from tabkit.operators.profile import box_stats
from tabkit.operators.ranks import assign_deciles
from tabkit.operators.reshape import distinct_values, missing_from, union_tables
from tabkit.operators.split import entity_role, year_role
from tabkit.operators.stages import CategoryMeanRegressor, MeanRegressor
from tabkit.plans.registry import query, rounded, slot_of, table


def priced(spark, sf):
    """Order lines with part type and brand; every fifth order is a test order."""
    lines = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    joined = lines.join(part, lines.l_partkey == part.p_partkey)
    return joined.select(
        "l_orderkey",
        "p_type",
        "p_brand",
        "p_size",
        (F.col("l_extendedprice") / 300).alias("actual"),
        F.when(F.pmod("l_orderkey", F.lit(5)) == 0, "test").otherwise("train").alias("role"),
    )


PRICED = """
r AS (SELECT l_orderkey, p_type, p_brand, p_size, l_extendedprice / 300 AS actual,
        CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS role
      FROM lineitem JOIN part ON l_partkey = p_partkey),
tm AS (SELECT p_type, avg(actual) AS pred FROM r WHERE role = 'train' AND p_type <> 'PROMO' GROUP BY 1),
bm AS (SELECT p_brand, avg(actual) AS pred FROM r WHERE role = 'train' GROUP BY 1),
m AS (SELECT avg(actual) AS pred FROM r WHERE role = 'train' AND p_type <> 'PROMO'),
m2 AS (SELECT avg(actual) AS pred FROM r WHERE role = 'train'),
p AS (SELECT r.*, coalesce(tm.pred, m.pred) AS pred, coalesce(bm.pred, m2.pred) AS pred_brand, m2.pred AS pred_mean
      FROM r LEFT JOIN tm USING (p_type) LEFT JOIN bm USING (p_brand), m, m2 WHERE role = 'test'),
e AS (SELECT *, actual - pred AS residual, pred - actual AS error, abs(actual - pred) AS abs_error FROM p)
"""

_GROUP = """count(*) AS n, round(avg(abs(pred - actual)), 4) AS mae, round(sqrt(avg((pred - actual) ** 2)), 4) AS rmse,
round(1 - sum((actual - pred) ** 2) / (count(*) * var_pop(actual)), 6) AS r2, round(avg(pred), 4) AS pred_mean,
round(avg(actual), 4) AS actual_mean"""


def predicted(spark, sf):
    """Test rows with the type-mean prediction; PROMO is not seen in training and gets the global mean."""
    rows = priced(spark, sf)
    train = rows.where((F.col("role") == "train") & (F.col("p_type") != "PROMO"))
    model = CategoryMeanRegressor(categoryCol="p_type", labelCol="actual", predictionCol="pred").fit(train)
    return E.with_errors(model.transform(rows.where(F.col("role") == "test")))


def predicted_by_three(spark, sf):
    rows = priced(spark, sf)
    train, test = rows.where(F.col("role") == "train"), predicted(spark, sf)
    brand = CategoryMeanRegressor(categoryCol="p_brand", labelCol="actual", predictionCol="pred_brand").fit(train)
    mean = MeanRegressor(labelCol="actual", predictionCol="pred_mean").fit(train)
    return mean.transform(brand.transform(test))


def _round_group(df):
    digits = {"mae": 4, "rmse": 4, "r2": 6, "pred_mean": 4, "actual_mean": 4}
    return df.withColumns({c: rounded(c, d) for c, d in digits.items()})


@query(f"WITH {PRICED} SELECT p_type, {_GROUP} FROM p GROUP BY 1 HAVING count(*) >= 100")
def type_errors(spark, sf, min_count=100):
    return _round_group(E.subgroup_errors(predicted(spark, sf), "p_type", min_count=min_count))


@query(f"""WITH {PRICED} SELECT nullif(p_brand, 'Brand#3') AS p_brand, {_GROUP} FROM p GROUP BY 1
HAVING count(*) >= (SELECT count(*) FROM p) / 26""")
def subgroup_errors_with_missing(spark, sf):
    """Missing is a group of its own here; small groups are left out."""
    rows = predicted(spark, sf).withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#3")))
    least = -(-rows.count() // 26)
    return _round_group(E.subgroup_errors(rows, "p_brand", min_count=least))


def _decile(value, key):
    return f"""'{{}} ' || CAST(greatest(1, ((row_number() OVER (ORDER BY {value}, {key}) - 1) * 10
      + (count(*) OVER () - 2)) // (count(*) OVER () - 1)) AS VARCHAR)"""


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year, o_totalprice AS actual,
             (SELECT avg(o_totalprice) FROM orders) AS pred, o_custkey FROM orders),
d AS (SELECT *, """ + _decile("actual", "o_orderkey").format("Target Decile") + """ AS td,
             """ + _decile("o_custkey", "o_orderkey").format("Floor Area Decile") + f""" AS ad FROM o)
SELECT 'Property Type' AS report, o_orderpriority AS group_value, {_GROUP} FROM d GROUP BY 2
UNION ALL SELECT 'Year', CAST(year AS VARCHAR), {_GROUP} FROM d GROUP BY 2
UNION ALL SELECT 'Target Decile', td, {_GROUP} FROM d GROUP BY 2
UNION ALL SELECT 'Floor Area Decile', ad, {_GROUP} FROM d GROUP BY 2
""")  # fmt: skip
def subgroup_reports(spark, sf):
    """Four groupings with one scan and one shuffle."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("actual")
    )
    rows = MeanRegressor(labelCol="actual", predictionCol="pred").fit(orders).transform(orders)
    rows = assign_deciles(rows, "actual", "o_orderkey", "td", "Target Decile")
    rows = assign_deciles(rows, "o_custkey", "o_orderkey", "ad", "Floor Area Decile")
    groups = {"Property Type": "o_orderpriority", "Year": "year", "Target Decile": "td", "Floor Area Decile": "ad"}
    return _round_group(E.subgroup_reports(rows, groups, min_count=1))


_BAND = """CASE WHEN actual < 0 THEN NULL WHEN actual <= 50 THEN '0-50' WHEN actual <= 100 THEN '51-100'
WHEN actual <= 150 THEN '101-150' WHEN actual <= 250 THEN '151-250' ELSE '250+' END"""
_BANDS = """b AS (SELECT * FROM (VALUES (1, '0-50'), (2, '51-100'), (3, '101-150'), (4, '151-250'), (5, '250+'))
  t(band_order, band))"""


def _banded(spark, sf):
    rows = predicted(spark, sf).where(F.col("actual") <= 250)
    return rows.withColumn("band", fixed_bands("actual", USE_EDGES, USE_LABELS))


@query(f"""WITH {PRICED}, {_BANDS}, s AS (SELECT {_BAND} AS band, abs_error FROM e WHERE actual <= 250)
SELECT b.band_order, b.band, count(s.band) AS n, round(avg(abs_error), 4) AS mae,
       round(median(abs_error), 4) AS median_ae
FROM b LEFT JOIN s USING (band) GROUP BY ALL""")
def band_errors(spark, sf):
    """The last band has no rows and stays in the report."""
    found = E.band_errors(_banded(spark, sf), "band", USE_LABELS)
    return found.withColumns({c: rounded(c) for c in ("mae", "median_ae")})


@query(f"""WITH {PRICED}, {_BANDS}, s AS (SELECT {_BAND} AS band, * FROM e WHERE actual <= 250)
SELECT b.band_order, b.band, count(s.band) AS n, round(avg(abs_error), 4) AS mae,
       round(avg(actual), 4) AS mean_actual, round(avg(pred), 4) AS mean_predicted,
       round(sqrt(avg(residual * residual)), 4) AS rmse, round(median(abs_error), 4) AS median_ae
FROM b LEFT JOIN s USING (band) GROUP BY ALL""")
def band_errors_wide(spark, sf):
    found = E.band_errors(_banded(spark, sf), "band", USE_LABELS, wide=True)
    return found.withColumns({c: rounded(c) for c in ("mae", "median_ae", "mean_actual", "mean_predicted", "rmse")})


@query(f"""WITH {PRICED}
SELECT p_brand, count(*) AS n, round(avg(abs_error), 4) AS mae, round(median(abs_error), 4) AS median_ae
FROM e WHERE p_brand <> 'Brand#3' GROUP BY 1 HAVING count(*) >= 30""")
def category_errors(spark, sf):
    rows = predicted(spark, sf).withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#3")))
    found = E.category_errors(rows, "p_brand", min_count=30)
    return found.withColumns({c: rounded(c) for c in ("mae", "median_ae")})


@query(f"""WITH {PRICED}
SELECT p_type, count(*) AS n, round(avg(abs_error), 4) AS mae, round(avg(actual), 4) AS mean_actual,
       round(avg(pred), 4) AS mean_predicted, round(sqrt(avg(residual * residual)), 4) AS rmse,
       round(median(abs_error), 4) AS median_ae
FROM e GROUP BY 1 HAVING count(*) >= 10""")
def category_errors_wide(spark, sf):
    found = E.category_errors(predicted(spark, sf), "p_type", min_count=10, wide=True)
    return found.withColumns({c: rounded(c) for c in ("mae", "median_ae", "mean_actual", "mean_predicted", "rmse")})


@query(f"""WITH {PRICED}, c AS (SELECT p_brand, avg(abs_error) AS mae FROM e GROUP BY 1),
h AS (SELECT *, row_number() OVER (ORDER BY mae DESC, p_brand) AS hard, row_number() OVER (ORDER BY mae, p_brand) AS easy
      FROM c)
SELECT p_brand, round(mae, 4) AS mae, 'hardest' AS side FROM h WHERE hard <= 10
UNION ALL SELECT p_brand, round(mae, 4), 'easiest' FROM h WHERE easy <= 10""")
def hardest_and_easiest(spark, sf):
    found = E.hardest_and_easiest(E.category_errors(predicted(spark, sf), "p_brand"), "p_brand", 10)
    return found.select("p_brand", rounded("mae").alias("mae"), "side")


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice AS actual, (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0)
  AS pred FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, actual, round(pred, 4) AS pred, round(pred - actual, 4) AS error,
       round(abs(pred - actual), 4) AS abs_error
FROM o ORDER BY abs(pred - actual) DESC, pred DESC, o_orderkey LIMIT 20
""")
def worst_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("actual"))
    held = F.pmod("o_orderkey", F.lit(5)) == 0
    model = MeanRegressor(labelCol="actual", predictionCol="pred").fit(orders.where(~held))
    found = E.worst_rows(E.with_errors(model.transform(orders.where(held))), 20, ["o_orderkey"])
    return found.select("o_orderkey", "actual", *[rounded(c).alias(c) for c in ("pred", "error", "abs_error")])


@query("""
WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS actual, n_chars * (1 + doc_id % 7) AS pred,
                  ln(1 + n_chars * (1 + doc_id % 7)) AS pred_log FROM documents)
SELECT min(actual) AS actual_min, max(actual) AS actual_max, CAST(min(pred) AS DOUBLE) AS pred_min,
       CAST(max(pred) AS DOUBLE) AS pred_max,
       count(*) FILTER (WHERE pred > (SELECT max(actual) FROM d)) AS count_above_max,
       count(*) FILTER (WHERE pred > 2 * (SELECT max(actual) FROM d)) AS count_above_2x_max,
       count(*) FILTER (WHERE pred > 5 * (SELECT max(actual) FROM d)) AS count_above_5x_max,
       round(max(pred_log), 6) AS pred_log_max, round(quantile_cont(actual, 0.99), 4) AS actual_p99,
       round(quantile_cont(pred, 0.99), 4) AS pred_p99, round(quantile_cont(pred, 0.995), 4) AS pred_p995,
       round(quantile_cont(pred_log, 0.99), 6) AS pred_log_p99
FROM d
""")
def range_diagnosis(spark, sf):
    pred = (F.col("n_chars") * (1 + F.pmod("doc_id", F.lit(7)))).cast("double")
    docs = table(spark, sf, "documents").select(
        F.col("n_chars").cast("double").alias("actual"), pred.alias("pred"), F.log1p(pred).alias("pred_log")
    )
    found = E.range_diagnosis(docs, "actual", "pred", "pred_log")
    return found.withColumns(
        {c: rounded(c) for c in ("actual_p99", "pred_p99", "pred_p995")}
        | {c: rounded(c, 6) for c in ("pred_log_max", "pred_log_p99")}
    )


_METRICS = """mt AS (
  SELECT 'type_mean' AS model, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) ** 2)) AS rmse,
         1 - sum((actual - pred) ** 2) / (count(*) * var_pop(actual)) AS r2, min(pred) AS pred_min,
         quantile_cont(pred, 0.995) AS pred_p995, max(pred) AS pred_max FROM p
  UNION ALL SELECT 'brand_mean', avg(abs(actual - pred_brand)), sqrt(avg((actual - pred_brand) ** 2)),
         1 - sum((actual - pred_brand) ** 2) / (count(*) * var_pop(actual)), min(pred_brand),
         quantile_cont(pred_brand, 0.995), max(pred_brand) FROM p
  UNION ALL SELECT 'mean', avg(abs(actual - pred_mean)), sqrt(avg((actual - pred_mean) ** 2)),
         1 - sum((actual - pred_mean) ** 2) / (count(*) * var_pop(actual)), min(pred_mean),
         quantile_cont(pred_mean, 0.995), max(pred_mean) FROM p)"""
_MODELS = {"type_mean": "pred", "brand_mean": "pred_brand", "mean": "pred_mean"}


def metrics_of_three(spark, sf, with_range=True):
    return E.model_metrics(predicted_by_three(spark, sf), "actual", _MODELS, with_range)


@query(f"""WITH {PRICED}, {_METRICS}
SELECT model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(pred_min, 4) AS pred_min,
       round(pred_p995, 4) AS pred_p995, round(pred_max, 4) AS pred_max FROM mt""")
def model_metrics(spark, sf):
    found = metrics_of_three(spark, sf)
    return found.withColumns(
        {c: rounded(c, 6) for c in ("mae", "rmse", "r2")}
        | {c: rounded(c) for c in ("pred_min", "pred_p995", "pred_max")}
    )


@query(f"""WITH {PRICED}, {_METRICS}, best AS (SELECT model, rmse FROM mt ORDER BY rmse, model LIMIT 1)
SELECT best.model AS best_model, round(best.rmse, 6) AS best_rmse, round(d.rmse, 6) AS dummy_rmse,
       round((d.rmse - best.rmse) / d.rmse * 100, 4) AS gain_pct
FROM best, mt d WHERE d.model = 'mean'""")
def rmse_gain(spark, sf):
    found = E.rmse_gain(metrics_of_three(spark, sf, False), "mean")
    return found.withColumns({"best_rmse": rounded("best_rmse", 6), "dummy_rmse": rounded("dummy_rmse", 6), "gain_pct": rounded("gain_pct")})


@query(f"""WITH {PRICED}, {_METRICS}, l AS (
  SELECT 'mae' AS metric, (SELECT mae FROM mt WHERE model = 'mean') AS a, (SELECT mae FROM mt WHERE model = 'brand_mean') AS b
  UNION ALL SELECT 'rmse', (SELECT rmse FROM mt WHERE model = 'mean'), (SELECT rmse FROM mt WHERE model = 'brand_mean')
  UNION ALL SELECT 'r2', (SELECT r2 FROM mt WHERE model = 'mean'), (SELECT r2 FROM mt WHERE model = 'brand_mean'))
SELECT metric, round(a, 6) AS baseline, round(b, 6) AS tuned, round(b - a, 6) AS delta FROM l""")
def metric_deltas(spark, sf):
    found = E.metric_table(metrics_of_three(spark, sf, False), "mean", "brand_mean")
    return found.withColumns({c: rounded(c, 6) for c in ("baseline", "tuned", "delta")})


@query(f"""WITH {PRICED}, w AS (SELECT abs(actual - pred_mean) - abs(actual - pred_brand) AS gain FROM p)
SELECT CASE WHEN gain > 0 THEN 'brand_mean' WHEN gain < 0 THEN 'mean' ELSE 'Tie' END AS winner, count(*) AS n,
       round(avg(gain), 6) AS mean_gain FROM w GROUP BY 1""")
def win_and_tie(spark, sf):
    rows = predicted_by_three(spark, sf)
    found = E.compare_two(rows, "actual", "pred_mean", "pred_brand", ("mean", "brand_mean"))
    return found.groupBy("winner").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("error_improvement"), 6).alias("mean_gain")
    )


@query(f"""WITH {PRICED}, l AS (SELECT 'mean' AS model, abs(actual - pred_mean) AS x FROM p
  UNION ALL SELECT 'brand_mean', abs(actual - pred_brand) FROM p),
q AS (SELECT model, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY 1)
SELECT model, count(*) AS n, round(max(q1), 4) AS q1, round(max(median), 4) AS median, round(max(q3), 4) AS q3,
       round(min(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5), 4) AS whisker_low,
       round(max(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5), 4) AS whisker_high,
       count(*) FILTER (WHERE NOT (x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)) AS outliers
FROM l JOIN q USING (model) GROUP BY 1""")
def error_boxes_by_model(spark, sf):
    rows = predicted_by_three(spark, sf)
    two = E.compare_two(rows, "actual", "pred_mean", "pred_brand", ("mean", "brand_mean"))
    long = E.long_errors(two, [], {"mean": "first_abs_error", "brand_mean": "second_abs_error"})
    found = box_stats(long, "abs_error", by=["model"])
    return found.withColumns({c: rounded(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


_TWO_SPLITS = """
o AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS y, year(o_orderdate) AS year, o_custkey FROM orders),
s AS (SELECT 'year' AS split, y, o_orderpriority AS c, CASE WHEN year < 2000 THEN 'train' WHEN year = 2000 THEN 'test' END
        AS role FROM o
      UNION ALL SELECT 'group', y, o_orderpriority, CASE WHEN (o_custkey * 2654435761) % 10000 < 2000 THEN 'test'
        ELSE 'train' END FROM o),
g AS (SELECT split, avg(y) AS p FROM s WHERE role = 'train' GROUP BY 1),
cg AS (SELECT split, c, avg(y) AS p FROM s WHERE role = 'train' GROUP BY 1, 2),
pr AS (SELECT s.split, s.y, g.p AS a, cg.p AS b FROM s JOIN g USING (split) JOIN cg USING (split, c) WHERE role = 'test'),
mt AS (SELECT split, 'mean' AS model, avg(abs(y - a)) AS mae, sqrt(avg((y - a) ** 2)) AS rmse,
              1 - sum((y - a) ** 2) / (count(*) * var_pop(y)) AS r2 FROM pr GROUP BY 1
       UNION ALL SELECT split, 'category_mean', avg(abs(y - b)), sqrt(avg((y - b) ** 2)),
              1 - sum((y - b) ** 2) / (count(*) * var_pop(y)) FROM pr GROUP BY 1)
"""


def two_split_metrics(spark, sf):
    """Two baselines under a year and an entity holdout, stacked with their tags."""
    orders = table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "y": F.col("o_totalprice")})
    roles = {
        "year": year_role(orders, "year", 2000),
        "group": entity_role(orders, "o_custkey", "o_orderkey", slot=slot_of("o_custkey")),
    }
    out = []
    for split, rows in roles.items():
        train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
        mean = MeanRegressor(labelCol="y", predictionCol="a").fit(train)
        category = CategoryMeanRegressor(categoryCol="o_orderpriority", labelCol="y", predictionCol="b").fit(train)
        scored = category.transform(mean.transform(test))
        found = E.model_metrics(scored, "y", {"mean": "a", "category_mean": "b"}, with_range=False)
        out.append(found.select(F.lit(split).alias("split"), "*"))
    return union_tables(out)


@query(f"""WITH {_TWO_SPLITS} SELECT model, round(max(CASE WHEN split = 'year' THEN rmse END), 4) AS year,
round(max(CASE WHEN split = 'group' THEN rmse END), 4) AS "group" FROM mt GROUP BY 1""")
def metric_pivot(spark, sf):
    found = E.metric_pivot(two_split_metrics(spark, sf), "rmse", "split", ["year", "group"])
    return found.withColumns({c: rounded(c) for c in ("year", "group")})


@query(f"""WITH {_TWO_SPLITS}, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rmse, mae, model) AS place FROM mt)
SELECT split, model, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2,
       place = 1 AS selected FROM k""")
def best_per_split(spark, sf):
    metrics = two_split_metrics(spark, sf)
    best = E.best_models(metrics, ["split"]).select("split", F.col("model").alias("best"))
    return metrics.join(best, "split").select(
        "split", "model", rounded("mae").alias("mae"), rounded("rmse").alias("rmse"), rounded("r2", 6).alias("r2"),
        (F.col("model") == F.col("best")).alias("selected"),
    )


@query(f"""WITH {_TWO_SPLITS} SELECT split, model, round(rmse, 4) AS rmse FROM mt WHERE model <> 'mean'""")
def best_learned_models(spark, sf):
    """Baselines named in the exclusion list are never selected."""
    found = E.best_models(two_split_metrics(spark, sf), ["split"], exclude=["mean"])
    return found.select("split", "model", rounded("rmse").alias("rmse"))


@query(f"""WITH {_TWO_SPLITS} SELECT printf('%s holdout: %s has MAE %.2f, RMSE %.2f and R2 %.3f', split, model, mae, rmse, r2)
AS sentence FROM mt""")
def summary_sentences(spark, sf):
    text = F.format_string(
        "%s holdout: %s has MAE %.2f, RMSE %.2f and R2 %.3f", "split", "model", "mae", "rmse", "r2"
    )
    return two_split_metrics(spark, sf).select(text.alias("sentence"))


@query("""
SELECT 'category_mean' AS model, 'seen' AS kind UNION ALL SELECT 'mean', 'seen'
UNION ALL SELECT DISTINCT o_orderstatus, 'not a line status' FROM orders
  WHERE o_orderstatus NOT IN (SELECT l_linestatus FROM lineitem)
""")
def distinct_and_missing_names(spark, sf):
    names = distinct_values(two_split_metrics(spark, sf), "model").withColumn("kind", F.lit("seen"))
    status = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"))
    lines = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("model"))
    return names.unionByName(missing_from(status, lines, "model").withColumn("kind", F.lit("not a line status")))


@query("""
SELECT p_type, count(*) FILTER (WHERE b = 'Brand#1') AS "Brand#1", count(*) FILTER (WHERE b = 'Brand#2') AS "Brand#2",
       count(*) FILTER (WHERE b = 'none') AS "none"
FROM (SELECT p_type, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand
        WHEN p_type = 'SMALL' THEN 'none' END AS b FROM part) WHERE b IS NOT NULL GROUP BY 1
""")
def crosstab(spark, sf):
    b = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_brand")).when(F.col("p_type") == "SMALL", "none")
    return E.crosstab(table(spark, sf, "part").withColumn("b", b), "p_type", "b", ["Brand#1", "Brand#2", "none"])


@query("""
WITH d AS (SELECT lang, source FROM documents WHERE lang <> 'de' AND NOT (lang = 'en' AND source IN ('src1', 'src2'))),
c AS (SELECT lang, source, count(*) AS n FROM d GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT lang FROM d), (SELECT DISTINCT source FROM d WHERE source IS NOT NULL))
SELECT lang, source, coalesce(n, 0) AS n,
       round_even(coalesce(n, 0) * 100.0 / sum(n) OVER (PARTITION BY lang), 2) AS row_pct FROM g LEFT JOIN c USING (lang, source)
""")
def crosstab_share(spark, sf):
    docs = table(spark, sf, "documents").withColumn("lang", F.nullif("lang", F.lit("de")))
    docs = docs.where(~((F.col("lang") == "en") & F.col("source").isin("src1", "src2")))
    return E.crosstab_share(docs, "lang", "source")
