"""Fitted models: closed forms with SQL, then forests, boosting, tuning and explanations (rows only).

Trees are as many and as deep as the library's defaults.
"""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabkit.operators import explain as X
from tabkit.operators import models as M
from tabkit.operators.reshape import union_tables
from tabkit.operators.stages import CategoryMeanRegressor, MeanRegressor, RidgeRegression
from tabkit.plans import disclosure as D
from tabkit.plans import regression as R
from tabkit.plans.catalogue.features import DISCLOSED, LAYOUT, disclosed
from tabkit.plans.registry import query, rounded, table
from tabkit.session import written


def _one_feature(spark, sf, model):
    lines = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("y"))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["l_quantity"], outputCol="features"), model]).fit(lines)
    last = fitted.stages[-1]
    return lines.agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.lit(float(last.coefficients[0])), 3).alias("slope"),
        rounded(F.lit(float(last.intercept)), 2).alias("intercept"),
    )


@query("""
SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem
""")
def ols_single(spark, sf):
    return _one_feature(spark, sf, LinearRegression(labelCol="y", regParam=0.0))


@query("""
WITH s AS (SELECT count(*) AS n, covar_pop(l_extendedprice, l_quantity) AS y1, covar_pop(l_extendedprice, l_tax) AS y2,
    covar_pop(l_quantity, l_tax) AS x12, var_pop(l_quantity) AS x11, var_pop(l_tax) AS x22 FROM lineitem)
SELECT 'l_quantity' AS feature, round((y1 * x22 - y2 * x12) / (x11 * x22 - x12 * x12), 2) AS coefficient FROM s
UNION ALL SELECT 'l_tax', round((y2 * x11 - y1 * x12) / (x11 * x22 - x12 * x12), 2) FROM s
""")
def ols_pair(spark, sf):
    """Two features at once, through the near-reconstruction report."""
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.col("l_extendedprice").alias("y"))
    _, coefficients = R.near_reconstruction(lines, lines, ["l_quantity", "l_tax"], "y")
    return coefficients.select("feature", rounded("coefficient", 2).alias("coefficient"))


@query("""
WITH s AS (SELECT count(*) AS n, covar_pop(l_extendedprice, l_quantity) * count(*) AS xy,
                  var_pop(l_quantity) * count(*) AS xx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT n, round(xy / (xx + n * 50.0), 3) AS slope, round(my - xy / (xx + n * 50.0) * mx, 2) AS intercept FROM s
""")
def ridge_single(spark, sf):
    """The penalty is scaled with the rows here, so that it stays visible at every size."""
    n = table(spark, sf, "lineitem").count()
    return _one_feature(spark, sf, RidgeRegression(alpha=50.0 * n, labelCol="y"))


_PERMUTED = """
WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS y FROM orders),
m AS (SELECT p, avg(y) AS pred FROM o WHERE id % 5 <> 0 GROUP BY 1),
f AS (SELECT o.*, m.pred, row_number() OVER (ORDER BY id) - 1 AS place FROM o JOIN m USING (p) WHERE id % 5 = 0),
z AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS base FROM f),
walk(place, r, l, q, i) AS (
  SELECT place, r, place // base, place % base, 0 FROM f, z, (SELECT range AS r FROM range(3))
  UNION ALL SELECT place, r, q, (l + ((q + 1) * 2654435761 + (42 * 1009 + r) * (i % 4 + 1) * 40503) % 4294967291 % base) % base, i + 1
  FROM walk, z WHERE i = 0 OR i % 4 <> 0 OR l * base + q >= n),
moved AS (SELECT place, r, l * base + q AS target FROM walk, z WHERE i > 0 AND i % 4 = 0 AND l * base + q < n),
e AS (SELECT r, sqrt(avg((t.y - m.pred) ** 2)) AS e FROM moved JOIN f AS s USING (place) JOIN f AS t ON t.place = target JOIN m ON m.p = s.p GROUP BY 1)
SELECT 'o_orderpriority' AS feature,
       round(avg(e) - (SELECT sqrt(avg((y - pred) ** 2)) FROM f), 4) AS importance_mean,
       round(stddev_pop(e), 4) AS importance_std FROM e
UNION ALL SELECT 'o_orderstatus', 0.0, 0.0
"""


@query(_PERMUTED)
def permutation_importance(spark, sf):
    """Shuffling the priority changes the category-mean model; shuffling the unused status changes nothing."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    held = F.pmod("o_orderkey", F.lit(5)) == 0
    model = CategoryMeanRegressor(categoryCol="o_orderpriority", labelCol="o_totalprice").fit(orders.where(~held))
    found = X.permutation_importance(
        model.transform,
        orders.where(held),
        ["o_orderpriority", "o_orderstatus"],
        "o_totalprice",
        "o_orderkey",
        repeats=3,
    )
    return found.select(
        "feature",
        (rounded("importance_mean") + F.lit(0.0)).alias("importance_mean"),
        rounded("importance_std").alias("importance_std"),
    )


FEATURES = M.Features(["p_size", "l_discount", "l_quantity"], ["p_type"], min_category_count=20)


def _wide(spark, sf):
    """Order lines with a unique content key, features and a target; every fifth order is a test order."""
    lines = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    joined = lines.join(part, lines.l_partkey == part.p_partkey)
    key = F.xxhash64(*[F.col(c) for c in lines.columns])
    return joined.select(
        key.alias("id"),
        "p_size",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        "l_quantity",
        F.nullif("p_type", F.lit("PROMO")).alias("p_type"),
        "p_brand",
        (F.col("l_extendedprice") / 1000).alias("target"),
        (F.pmod("l_orderkey", F.lit(5)) == 0).alias("held"),
    )


def _parts(spark, sf):
    rows = _wide(spark, sf)
    return rows.where("not held"), rows.where("held")


def _forest(train):
    return M.fit_shared(train, {"forest": M.recipe(FEATURES, M.forest("target"))})["forest"]


@query()
def model_comparison(spark, sf):
    """Mean, category mean, least squares, ridge and forest on the same test rows."""
    train, test = _parts(spark, sf)
    models = M.candidate_models(FEATURES, "target", "p_type", dummy=True)
    metrics, _, _ = M.compare_models(train, test, models, "target", clip_at_zero=True)
    return metrics


@query()
def boosted_trees(spark, sf):
    """300 rounds on sampled rows and columns, by Spark's own boosting."""
    train, test = _parts(spark, sf)
    models = {"boosted": M.recipe(FEATURES, M.boosted_unpenalised("target"))}
    metrics, _, _ = M.compare_models(train, test, models, "target")
    return metrics


@query()
def validation_tuning(spark, sf):
    """All named forest settings scored on an inner validation part."""
    train, _ = _parts(spark, sf)
    table_, best, _ = M.validation_search(train, FEATURES, "target", "id")
    return table_.withColumn("selected", F.col("model") == F.lit(best))


@query()
def random_search(spark, sf):
    """Five random draws of one space and eight of the other, three folds; every fill and category is refitted per fold."""
    train, _ = _parts(spark, sf)
    found, _ = M.random_searches(train, FEATURES, "target", "id", {"score": (M.SCORE_SPACE, 5), "emission": (M.EMISSION_SPACE, 8)})
    return found


_LEVELS = """
WITH r AS (SELECT l_linenumber AS x, (l_linenumber % 2) * 100 + l_extendedprice / 1000 AS y, l_orderkey % 5 = 0 AS held FROM lineitem),
g AS (SELECT x, greatest(avg(y), 0) AS pred FROM r WHERE NOT held GROUP BY 1),
p AS (SELECT y, pred, (SELECT avg(y) FROM r WHERE NOT held) AS flat FROM r JOIN g USING (x) WHERE held),
m AS (SELECT 'tree' AS kind, y, pred FROM p UNION ALL SELECT 'mean', y, flat FROM p),
e AS (SELECT kind, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) ** 2)), 6) AS rmse,
  round(1 - sum((y - pred) ** 2) / (count(*) * var_pop(y)), 6) AS r2, round(min(pred), 6) AS pred_min,
  round(quantile_cont(pred, 0.995), 6) AS pred_p995, round(max(pred), 6) AS pred_max FROM m GROUP BY 1)
"""
MEASURES = "mae rmse r2 pred_min pred_p995 pred_max".split()
LEVELS = M.Features(["x"])


def _levels(spark, sf):
    """A target that differs between seven levels: any tree that is deep enough predicts the levels' training means."""
    lines = table(spark, sf, "lineitem")
    y = F.pmod("l_linenumber", F.lit(2)) * 100 + F.col("l_extendedprice") / 1000
    held = F.pmod("l_orderkey", F.lit(5)) == 0
    key = F.xxhash64(*[F.col(c) for c in lines.columns]).alias("id")
    rows = lines.select(key, F.col("l_linenumber").cast("double").alias("x"), y.alias("y"), held.alias("held"))
    return rows.where("not held"), rows.where("held")


def _measured(metrics):
    return metrics.select("model", *[rounded(c, 6).alias(c) for c in MEASURES])


@query(f"{_LEVELS} SELECT 'mean' AS model, * EXCLUDE kind FROM e WHERE kind = 'mean' "
       "UNION ALL SELECT 'forest', * EXCLUDE kind FROM e WHERE kind = 'tree'")  # fmt: skip
def full_forest(spark, sf):
    """The forest of the comparison at full size (300 trees of depth 30), without resampling, so that SQL knows its values."""
    train, test = _levels(spark, sf)
    models = {"mean": Pipeline(stages=[MeanRegressor(labelCol="y")]), "forest": M.recipe(LEVELS, M.forest("y", bootstrap=False))}
    metrics, _, _ = M.compare_models(train, test, models, "y", clip_at_zero=True)
    return _measured(metrics)


@query(f"""{_LEVELS},
lv AS (SELECT x, count(*) AS n, avg(y) AS mean FROM r WHERE NOT held GROUP BY 1),
t AS (SELECT avg(y) AS start FROM r WHERE NOT held),
b AS (SELECT x, start + (mean - start) * (1 - (1 - 0.05 * n / (n + 1.0)) ** 300) AS pred FROM lv, t),
q AS (SELECT y, greatest(b.pred, 0) AS pred FROM r JOIN b USING (x) WHERE held)
SELECT 'boosted' AS model, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) ** 2)), 6) AS rmse,
  round(1 - sum((y - pred) ** 2) / (count(*) * var_pop(y)), 6) AS r2, round(min(pred), 6) AS pred_min,
  round(quantile_cont(pred, 0.995), 6) AS pred_p995, round(max(pred), 6) AS pred_max FROM q""")
def full_boosting(spark, sf):
    """Boosting at full size (300 rounds, depth 6, L2 1), without sampling: each level nears its mean by a known share a round."""
    train, test = _levels(spark, sf)
    models = {"boosted": M.recipe(LEVELS, M.boosted("y", subsamplingRate=1.0, featureSubsetStrategy="all"))}
    metrics, _, _ = M.compare_models(train, test, models, "y", clip_at_zero=True)
    return _measured(metrics)


@query("""
WITH r AS (SELECT l_quantity AS x, l_extendedprice / 1000 + CASE WHEN l_quantity > 17 THEN 40 ELSE 0 END AS y, l_orderkey % 5 = 0 AS held FROM lineitem),
t AS (SELECT * FROM r WHERE NOT held), m AS (SELECT avg(y) AS start, count(*) AS n FROM t),
c AS (SELECT x, sum(sum(start - y)) OVER (ORDER BY x) AS gl, sum(count(*)) OVER (ORDER BY x) AS hl FROM t, m GROUP BY x),
s AS (SELECT x, gl, hl, n - hl AS hr, gl ** 2 / (hl + 500.0) + gl ** 2 / (n - hl + 500.0) AS gain FROM c, m WHERE hl < n),
b AS (SELECT * FROM s ORDER BY gain DESC, x LIMIT 1)
SELECT r.x, round(any_value(start + CASE WHEN r.x <= b.x THEN -gl / (hl + 500.0) ELSE gl / (hr + 500.0) END), 6) AS pred, count(*) AS n
FROM r, b, m WHERE held GROUP BY 1""")
def boosted_stump(spark, sf):
    """One round, one split, a heavy L2 term: it enters the choice of the cut and both leaves."""
    lines = table(spark, sf, "lineitem")
    y = F.col("l_extendedprice") / 1000 + F.when(F.col("l_quantity") > 17, F.lit(40)).otherwise(F.lit(0))
    rows = lines.select(F.col("l_quantity").alias("x"), y.alias("y"), (F.pmod("l_orderkey", F.lit(5)) == 0).alias("held"))
    model = M.boosted("y", maxIter=1, maxDepth=1, stepSize=1.0, subsamplingRate=1.0, featureSubsetStrategy="all", l2=500.0)
    fitted = M.fit_shared(rows.where("not held"), {"stump": M.recipe(LEVELS, model)})["stump"]
    return fitted.transform(rows.where("held")).groupBy("x").agg(rounded(F.max("prediction"), 6).alias("pred"), F.count(F.lit(1)).alias("n"))


@query(f"{_LEVELS} SELECT 'mean' AS model, * EXCLUDE kind FROM e WHERE kind = 'mean' "
       "UNION ALL SELECT 'tuned_forest', * EXCLUDE kind FROM e WHERE kind = 'tree'")  # fmt: skip
def tuned_comparison(spark, sf):
    """Random search must find the deep trees; the tuned model then joins the ranking of the test rows."""
    train, test = _levels(spark, sf)
    metrics, _, _ = M.compare_models(train, test, {"mean": Pipeline(stages=[MeanRegressor(labelCol="y")])}, "y", clip_at_zero=True)
    space = M.SCORE_SPACE | {"maxDepth": [1, *M.SCORE_SPACE["maxDepth"]], "bootstrap": [False], "leastSplit": [2]}
    _, _, best = M.random_search(train, LEVELS, "y", "id", space, draws=5)
    return _measured(M.with_tuned(metrics, best, test, "y"))


_SETTINGS = "UNION ALL ".join(f"SELECT '{name}' AS model, mae, rmse, r2 FROM e WHERE kind = 'tree' " for name in M.FOREST_SETTINGS)


@query(f"{_LEVELS} {_SETTINGS}")
def settings_on_levels(spark, sf):
    """All seven forest settings from five forests, without resampling: on seven levels each must find the levels' means."""
    train, test = _levels(spark, sf)
    rows = train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1)))
    data = M.binned_rows(rows, LEVELS, "y", F.col("part"), F.col("part") == 0)
    settings = {name: {**s, "bootstrap": False} for name, s in M.FOREST_SETTINGS.items()}
    scored = M.scored_settings(data, list(settings.values()), "y", 42, [0], [1])
    scored = scored.select("y", *[F.greatest(F.col(f"p{i}"), F.lit(0.0)).alias(f"pred_{name}") for i, name in enumerate(settings)])
    found = M.settled_metrics(scored, "y", list(settings), with_range=False)
    return found.select("model", *[rounded(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query()
def feature_effects(spark, sf):
    """Coefficients of the linear model and importances of the forest, by readable feature name."""
    train, test = _parts(spark, sf)
    models = M.candidate_models(FEATURES, "target")
    fitted = M.fit_shared(train, models)
    return union_tables([X.feature_effects(m, m.transform(test), FEATURES, name) for name, m in fitted.items()])


@query()
def tree_statistics(spark, sf):
    train, _ = _parts(spark, sf)
    return X.tree_statistics(_forest(train), spark)


@query()
def forest_permutation(spark, sf):
    """Permutation importance of a forest on all test rows."""
    train, test = _parts(spark, sf)
    fitted = _forest(train)
    return X.permutation_importance(fitted.transform, test, FEATURES.columns, "target", "id")


@query()
def cap_sensitivity_of_fit(spark, sf):
    """Rows and test errors of a forest under three target caps, as masks over one set of bins."""
    caps = {"P95": 0.95, "P99": 0.99, "NoUpperCap": None}
    return M.capped_forests(_wide(spark, sf), FEATURES, "target", F.col("held"), caps)


def _engineered(spark, sf):
    raw = disclosed(spark, sf)
    frame, kinds = D.engineer(D.clean_anomalies(raw, LAYOUT), LAYOUT)
    key = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns if c in frame.columns])
    return D.modelling_rows(frame, LAYOUT).withColumn("id", key), D.scenarios(kinds)


def _stored(spark, sf):
    rows, sets = _engineered(spark, sf)
    dealt = M.spread(rows)
    rows = written(dealt, "modelling-rows")
    dealt.unpersist()
    return rows, sets


def _evaluations(spark, sf, names, split):
    rows, sets = _stored(spark, sf)
    return _evaluated(rows, {name: sets[name] for name in names}, split)


def _evaluated(rows, sets, split):
    return R.run_scenarios(rows, sets, "target", split, year="year", entity=D.BUILDING_ID, key="id", category=D.MODEL_TYPE)


@query()
def scenario_metrics(spark, sf):
    """All feature scenarios under the year holdout and two under the group holdout, all candidates, ranked."""
    rows, sets = _stored(spark, sf)
    found = _evaluated(rows, sets, "year")
    found += _evaluated(rows, {n: sets[n] for n in ("forecasting_strict", "estimation_full")}, "group")
    return R.all_metrics(found).orderBy("split", "scenario", "rmse")


@query(f"""WITH {DISCLOSED}, m AS (SELECT * FROM d WHERE area IS NOT NULL),
r AS (SELECT *, CASE WHEN year < (SELECT max(year) FROM m) THEN 'train' ELSE 'test' END AS role FROM m),
b AS (SELECT quantile_cont(target, 0.99) AS bound FROM r WHERE role = 'train'),
k AS (SELECT type, count(*) AS n FROM r, b WHERE role = 'train' AND target <= bound GROUP BY 1)
SELECT 'forecasting_strict' AS scenario, 'year' AS split,
       count(*) FILTER (WHERE role = 'train' AND target <= bound) AS train_rows,
       count(*) FILTER (WHERE role = 'test' AND target <= bound) AS test_rows,
       count(*) FILTER (WHERE role = 'train' AND target > bound) AS train_rows_removed,
       count(*) FILTER (WHERE role = 'test' AND target > bound) AS test_rows_removed,
       CAST(5 AS INTEGER) AS raw_columns, CAST(4 AS INTEGER) AS numeric_columns, CAST(1 AS INTEGER) AS categorical_columns,
       CAST(4 + (SELECT count(DISTINCT CASE WHEN n >= 200 THEN type ELSE 'Other' END) FROM k) AS INTEGER)
         AS transformed_columns
FROM r, b""")
def scenario_counts(spark, sf):
    """Rows and columns of a scenario under the year holdout."""
    rows, sets = _stored(spark, sf)
    return R.scenario_counts(rows, "forecasting_strict", sets["forecasting_strict"], "target", "year", year="year")


@query()
def scenario_reports(spark, sf):
    """Subgroup errors of the best learned model, by type, year, target decile and area decile."""
    (found,) = _evaluations(spark, sf, ["estimation_full"], "group")
    frame = R.prediction_frame(found, R.best_learned(found), "target", "id", D.MODEL_AREA)
    return R.reports(frame, D.MODEL_TYPE, "year", min_count=30)


@query()
def scenario_tracks(spark, sf):
    found = _evaluations(spark, sf, ["forecasting_strict", "estimation_full"], "year")
    return R.track_summary(R.all_metrics(found), {"forecasting_strict": "Forecasting", "estimation_full": "Estimation"})


@query(f"""WITH {DISCLOSED},
m AS (SELECT year, target AS y, coalesce(f1 / area, 0) AS a, coalesce(f2 / area, 0) AS b, coalesce(f3 / area, 0) AS c FROM d WHERE area IS NOT NULL),
s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc,
        covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy FROM m WHERE year < (SELECT max(year) FROM m)),
x AS (SELECT *, aa * (bb * cc - bc ** 2) - ab * (ab * cc - ac * bc) + ac * (ab * bc - ac * bb) AS det FROM s),
f AS (SELECT 'quantity_intensity' AS feature, (ay * (bb * cc - bc ** 2) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS v FROM x
  UNION ALL SELECT 'discount_intensity', (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det FROM x
  UNION ALL SELECT 'tax_intensity', (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det FROM x)
SELECT feature, round(v, 3) AS coefficient, round(abs(v), 3) AS abs_coefficient FROM f""")
def near_reconstruction(spark, sf):
    """Coefficients of fuel intensities alone, largest first, from one table of products."""
    rows, sets = _engineered(spark, sf)
    intensities = [c for c in sets["fuel_derived_only"].numeric if c.endswith("_intensity")]
    rows = written(rows.select("year", "target", *intensities), "intensities")  # the tables are joined once for all that follows
    latest = rows.agg(F.max("year")).first()[0]
    _, coefficients = R.near_reconstruction(
        rows.where(F.col("year") < latest), rows.where(F.col("year") == latest), intensities, "target"
    )
    return coefficients.withColumns({c: rounded(c, 3) for c in ("coefficient", "abs_coefficient")})
