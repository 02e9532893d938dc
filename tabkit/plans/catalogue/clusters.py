"""Clustering: measures on given labels, profiles, names, assignment, fits."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabkit.operators import cluster as K
from tabkit.operators.evaluate import crosstab
from tabkit.operators.stages import PopulationScaler, Winsorizer
from tabkit.plans import segments as S
from tabkit.plans.registry import query, rounded, table
from tabkit.session import scratch_path
from tabkit.sources import artefacts


def _embedded(spark, sf):
    vectors = table(spark, sf, "embeddings")
    cells = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)]
    return vectors.select("vec_id", "label", *cells)


_LABELINGS = """
l AS (SELECT vec_id, label AS a, label // 2 AS b, CAST(vec_id % 10 AS INTEGER) AS c, 1 AS d FROM embeddings),
t AS (SELECT 'a' AS first, 'b' AS second, a AS p, b AS q FROM l UNION ALL SELECT 'a', 'c', a, c FROM l
      UNION ALL SELECT 'a', 'd', a, d FROM l UNION ALL SELECT 'b', 'c', b, c FROM l
      UNION ALL SELECT 'b', 'd', b, d FROM l UNION ALL SELECT 'c', 'd', c, d FROM l),
n AS (SELECT first, second, p, q, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT first, second, sum(n * (n - 1) / 2.0) AS together, sum(n) * (sum(n) - 1) / 2.0 AS pairs FROM n GROUP BY ALL),
pa AS (SELECT first, second, sum(m * (m - 1) / 2.0) AS a FROM (SELECT first, second, p, sum(n) AS m FROM n GROUP BY ALL)
       GROUP BY ALL),
qa AS (SELECT first, second, sum(m * (m - 1) / 2.0) AS b FROM (SELECT first, second, q, sum(n) AS m FROM n GROUP BY ALL)
       GROUP BY ALL)
"""


@query(f"""WITH {_LABELINGS}
SELECT first, second, round(coalesce((together - a * b / pairs) / nullif((a + b) / 2 - a * b / pairs, 0), 1.0), 6) AS ari
FROM g JOIN pa USING (first, second) JOIN qa USING (first, second)""")
def adjusted_rand(spark, sf):
    """All pairs of four labelings: true labels, merged ones, arbitrary ones, and a single cluster."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("label").alias("a"),
        F.floor(F.col("label") / 2).cast("int").alias("b"),
        F.pmod("vec_id", F.lit(10)).cast("int").alias("c"),
        F.lit(1).alias("d"),
    )
    return K.adjusted_rand(rows, {c: c for c in "abcd"}).withColumn("ari", rounded("ari", 6) + F.lit(0.0))


_SUMS = " + ".join(f"var_pop(CAST(embedding[{i}] AS DOUBLE))" for i in range(1, 65))


@query(f"""
SELECT round(sum(s), 4) AS inertia, count(*) AS n_clusters
FROM (SELECT label, count(*) * ({_SUMS}) AS s FROM embeddings GROUP BY 1)
""")
def inertia_of_labels(spark, sf):
    found = K.inertia(_embedded(spark, sf), [f"x{i}" for i in range(64)], "label")
    return found.withColumn("inertia", rounded("inertia"))


_SQUARED = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum({distance}) AS total, count(*) AS n
      FROM e a, e b GROUP BY ALL),
s AS (SELECT vec_id, max(total / greatest(n - 1, 1)) FILTER (WHERE label = other) AS inside,
             max(n) FILTER (WHERE label = other) AS own, min(total / n) FILTER (WHERE label <> other) AS outside
      FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN own > 1 THEN (outside - inside) / greatest(inside, outside) ELSE 0 END), 6) AS silhouette
"""


@query(_SQUARED.format(distance="list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2))") + " FROM s")
def squared_silhouette(spark, sf):
    """Squared distances, whole table, from sums per cluster: no pairs of rows."""
    rows = table(spark, sf, "embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    found = K.squared_silhouette(rows, "features", "label")
    return found.withColumn("silhouette", rounded("silhouette", 6))


@query(_SQUARED.format(distance="sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2)))")
       .replace("FROM embeddings)", "FROM embeddings ORDER BY (vec_id * 40503) % 1000003, vec_id LIMIT 2000)")
       + ", count(*) AS n_sampled FROM s")
def silhouette(spark, sf):
    """Euclidean silhouette of a sample of at most 2,000 rows, the size the measure is defined with."""
    found = K.silhouette(table(spark, sf, "embeddings"), "embedding", "label", "vec_id", order=F.pmod(F.col("k") * F.lit(40503), F.lit(1000003)))
    return found.withColumn("silhouette", rounded("silhouette", 6))


def spending(spark, sf):
    """Customers with the sum and number of their orders, in the roles of energy, water and area."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("n_orders"), F.max(F.year("o_orderdate")).alias("last_year")
    )
    customers = table(spark, sf, "customer")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left").drop("o_custkey")


_SPENDING = """
s AS (SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, sum(o_totalprice) AS spent, count(o_orderkey) AS n_orders,
        max(year(o_orderdate)) AS last_year
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
"""


@query(f"""WITH {_SPENDING}, c AS (SELECT c_nationkey % 3 AS cluster, c_acctbal * 2 AS twice, spent, n_orders FROM s),
m AS (SELECT cluster, avg(twice) AS centre FROM c GROUP BY 1)
SELECT cluster, count(*) AS n, round(avg(spent), 2) AS spent_mean, round(avg(twice), 4) AS balance_mean,
       round(median(spent), 4) AS spent_median, round(median(n_orders), 4) AS orders_median, round(max(centre), 4) AS centre
FROM c JOIN m USING (cluster) GROUP BY 1""")
def cluster_profile(spark, sf):
    rows = spending(spark, sf).withColumns(
        {"cluster": F.pmod("c_nationkey", F.lit(3)), "twice": F.col("c_acctbal") * 2, "orders": F.coalesce("n_orders", F.lit(0))}
    )
    centres = rows.groupBy("cluster").agg(F.avg("twice").alias("centre"))
    found = K.cluster_profile(
        rows,
        "cluster",
        {"spent_mean": "spent", "balance_mean": "twice"},
        {"spent_median": "spent", "orders_median": "orders"},
        centres,
    )
    return found.withColumns(
        {"spent_mean": rounded("spent_mean", 2)}
        | {c: rounded(c) for c in ("balance_mean", "spent_median", "orders_median", "centre")}
    )


@query(f"""WITH {_SPENDING}, m AS (SELECT c_nationkey % 3 AS cluster, avg(c_acctbal) AS energy, avg(spent) AS water FROM s
  GROUP BY 1),
h AS (SELECT cluster FROM m ORDER BY energy DESC, cluster LIMIT 1),
w AS (SELECT cluster FROM m WHERE cluster <> (SELECT cluster FROM h) ORDER BY water DESC, cluster LIMIT 1)
SELECT cluster, CASE WHEN cluster = (SELECT cluster FROM h) THEN 'High Energy - Moderate Water'
  WHEN cluster = (SELECT cluster FROM w) THEN 'Moderate Energy - Higher Water' ELSE 'Low Energy - Low Water' END
  AS cluster_name, round(energy, 4) AS energy, round(water, 2) AS water FROM m""")
def cluster_names(spark, sf):
    """Names follow the order of the centres, whatever the cluster ids."""
    rows = spending(spark, sf).withColumn("cluster", F.pmod("c_nationkey", F.lit(3)))
    centres = rows.groupBy("cluster").agg(F.avg("c_acctbal").alias("energy"), F.avg("spent").alias("water"))
    named = K.name_clusters(centres, "cluster", "energy", "water")
    return named.select("cluster", "cluster_name", rounded("energy").alias("energy"), rounded("water", 2).alias("water"))


@query(f"""WITH {_SPENDING}, u AS (SELECT * FROM s WHERE spent IS NOT NULL),
b AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi,
             quantile_cont(spent / n_orders, 0.01) AS lo2, quantile_cont(spent / n_orders, 0.99) AS hi2 FROM u),
w AS (SELECT *, greatest(least(c_acctbal, hi), lo) AS e, ln(1 + greatest(least(spent / n_orders, hi2), lo2)) AS v FROM u, b),
z AS (SELECT *, (e - (SELECT avg(e) FROM w)) / (SELECT stddev_pop(e) FROM w) AS ez,
             (v - (SELECT avg(v) FROM w)) / (SELECT stddev_pop(v) FROM w) AS vz FROM w),
m AS (SELECT c_nationkey % 3 AS cluster, avg(ez) AS a, avg(vz) AS c FROM z GROUP BY 1),
d AS (SELECT c_custkey, cluster, row_number() OVER (PARTITION BY c_custkey ORDER BY (ez - a) ** 2 + (vz - c) ** 2, cluster)
        AS place FROM z, m)
SELECT c_custkey, cluster FROM d WHERE place = 1""")
def assign_clusters(spark, sf):
    """Intensity, clip, log, scale, then the nearest of given centres (the scaled means of three groups)."""
    rows = spending(spark, sf).where(F.col("spent").isNotNull())
    rows = rows.withColumn("per_order", F.try_divide("spent", "n_orders"))
    ready = (
        Pipeline(
            stages=[
                Winsorizer(inputCols=["c_acctbal", "per_order"], outputCols=["e", "w"]),
                SQLTransformer(statement="SELECT *, log1p(w) AS v FROM __THIS__"),
                PopulationScaler(inputCols=["e", "v"], outputCols=["ez", "vz"]),
            ]
        )
        .fit(rows)
        .transform(rows)
    )
    means = ready.groupBy(F.pmod("c_nationkey", F.lit(3)).alias("g")).agg(F.avg("ez").alias("a"), F.avg("vz").alias("b"))
    centres = [(r["g"], (r["a"], r["b"])) for r in means.collect()]
    return K.nearest_centre(ready, ["ez", "vz"], sorted(centres)).select("c_custkey", "cluster")


COLUMNS = S.Columns("last_year", "c_acctbal", "spent", "n_orders", "c_mktsegment", "built")


def _segmented(spark, sf):
    rows = spending(spark, sf).withColumn("built", 1900 + F.pmod("c_custkey", F.lit(120)))
    latest = rows.agg(F.max("last_year")).first()[0]
    prepared = S.with_bins(S.prepare(rows, COLUMNS, latest), COLUMNS)
    return prepared, S.segment(prepared, k=3)


@query()
def segmentation(spark, sf):
    """Filter, intensity, clip, log, scale, k-means; named profile of the clusters."""
    _, (_, labelled, centres) = _segmented(spark, sf)
    return S.profile(labelled, centres, "n_orders")


@query()
def segments_by_vintage(spark, sf):
    _, (_, labelled, centres) = _segmented(spark, sf)
    named = labelled.join(F.broadcast(centres.select("cluster", "cluster_name")), "cluster")
    return crosstab(named, "cluster_name", "vintage_bin", ["Pre-1940", "1940-1979", "1980-1999", "2000 and later"])


@query()
def kmeans_sweep(spark, sf):
    """Inertia, silhouette and stability for k = 2..10 with five seeds of 20 starts each."""
    columns = [f"x{i}" for i in range(64)]
    rows = _embedded(spark, sf).select("vec_id", *columns)
    found = K.k_sweep(rows, columns, "vec_id")
    return found.select("k", *[rounded(c).alias(c) for c in found.columns if c != "k"])


_GROUP = "CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 10000 END"


@query(f"""WITH r AS (SELECT {_GROUP} + l_tax AS a, l_discount AS b, l_linenumber % 3 AS g FROM lineitem),
l AS (SELECT 2 AS k, a, b, CASE WHEN g = 2 THEN 1 ELSE 0 END AS c FROM r UNION ALL SELECT 3, a, b, g FROM r),
i AS (SELECT row_number() OVER () AS no, * FROM l),
m AS (SELECT k, c, count(*) AS n, avg(a) AS ma, avg(b) AS mb, count(*) * (var_pop(a) + var_pop(b)) AS sse FROM l GROUP BY 1, 2),
t AS (SELECT i.k, i.no, i.c = m.c AS own, m.n, m.n * ((a - ma) ** 2 + (b - mb) ** 2) + sse AS total FROM i JOIN m ON i.k = m.k),
s AS (SELECT k, no, max(total / (n - 1)) FILTER (WHERE own) AS inside, min(total / n) FILTER (WHERE NOT own) AS outside FROM t GROUP BY 1, 2)
SELECT CAST(s.k AS INTEGER) AS k, round((SELECT sum(sse) FROM m WHERE m.k = s.k), 3) AS inertia_mean,
  round(avg((outside - inside) / greatest(outside, inside)), 6) AS silhouette_mean, 1.0::DOUBLE AS stability_mean_ari FROM s GROUP BY s.k""")
def planted_sweep(spark, sf):
    """Three planted groups: for two and three clusters the best of 20 starts is known, and all seeds agree."""
    lines = table(spark, sf, "lineitem")
    group = F.pmod("l_linenumber", F.lit(3))
    level = F.when(group == 0, F.lit(0)).when(group == 1, F.lit(100)).otherwise(F.lit(10000))
    rows = lines.select((level + F.col("l_tax")).alias("a"), F.col("l_discount").alias("b"), F.col("l_orderkey").alias("id"))
    found = K.k_sweep(rows, ["a", "b"], "id", ks=(2, 3), seeds=K.SEEDS[:3], tolerance=1e-16)
    return found.withColumns({"inertia_mean": rounded("inertia_mean", 3), "silhouette_mean": rounded("silhouette_mean", 6)})


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'High Energy - Moderate Water' WHEN 1 THEN 'Moderate Energy - Higher Water'
  ELSE 'Low Energy - Low Water' END AS name, CASE WHEN p_size <> 1 THEN 1 END AS water FROM part)
SELECT CASE WHEN water IS NOT NULL THEN name END AS cluster_name, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys, 3 AS final_k FROM p GROUP BY 1""")
def cluster_bundle(spark, sf):
    """Segments of three planted groups are saved with their bounds and names, read again, and given to all rows."""
    group = F.pmod("p_partkey", F.lit(3))
    by_group = lambda *v: F.when(group == 0, F.lit(v[0])).when(group == 1, F.lit(v[1])).otherwise(F.lit(v[2]))
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_type", F.lit(2024).alias("y"), F.lit(100.0).alias("a"), F.lit(1950.0).alias("b"),
        (by_group(300.0, 120.0, 40.0) + F.col("p_size") / 10).alias("e"),
        F.when(F.col("p_size") != 1, by_group(200.0, 900.0, 100.0) + F.col("p_size") / 50).alias("w"),
    )
    columns = S.Columns("y", "e", "w", "a", "p_type", "b")
    model, _, centres = S.segment(S.prepare(rows, columns, 2024), k=3)
    path = artefacts.save_model(spark, model, scratch_path(spark, "segments"), S.artefact(model, centres, 3))
    loaded, about = artefacts.load_model(spark, path)
    found = S.assign(rows, loaded, about["cluster_names"], columns)
    return found.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.lit(about["final_k"]).cast("int").alias("final_k"))
