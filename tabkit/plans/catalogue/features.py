"""Engineered features, filling, grouping, encoding and scaling."""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tabkit.functions.names import slug_column, stable_id
from tabkit.operators.coding import CategoryCoder
from tabkit.operators.ranks import with_row_id
from tabkit.operators.stages import GroupMedianFill, MedianFill, ModeFill, PopulationScaler, RareGrouper
from tabkit.plans import disclosure as D
from tabkit.plans.registry import query, rounded, table

LAYOUT = D.Layout(
    target="target",
    year="year",
    ids=("id_1", "id_2"),
    types=("type_1", "type_2"),
    area="area",
    largest_area="largest_area",
    fuels=("quantity use (kbtu)", "discount use (kbtu)", "tax use (kbtu)"),
    metadata=("year", "part_size"),
)


def disclosed(spark, sf):
    """Order lines in the roles of a disclosure table, with missing ids, types, areas and fuels."""
    lines = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    joined = lines.join(part, lines.l_partkey == part.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        F.year("o_orderdate").cast("double").alias("year"),
        (F.col("l_extendedprice") / 1000).alias("target"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("id_1"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id_2"),
        F.nullif("p_type", F.lit("PROMO")).alias("type_1"),
        F.when(F.col("p_type") != "PROMO", F.col("p_brand"))
        .otherwise(F.nullif("p_brand", F.lit("Brand#1")))
        .alias("type_2"),
        F.when(F.col("p_size") > 5, F.col("p_size") * 10.0).alias("area"),
        F.when(F.col("p_size") > 2, F.col("p_retailprice")).alias("largest_area"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity use (kbtu)"),
        F.col("l_discount").alias("discount use (kbtu)"),
        F.nullif("l_tax", F.lit(0.03)).alias("tax use (kbtu)"),
        F.col("p_size").cast("double").alias("part_size"),
    )


DISCLOSED = """
d AS (SELECT l_orderkey, l_linenumber, year(o_orderdate) AS year, l_extendedprice / 1000 AS target,
        CASE WHEN o_orderstatus <> 'F' THEN 'c' || o_custkey ELSE 'o' || o_orderkey END AS id,
        coalesce(nullif(p_type, 'PROMO'), nullif(p_brand, 'Brand#1'), 'Missing') AS type,
        coalesce(CASE WHEN p_size > 5 THEN p_size * 10.0 END, CASE WHEN p_size > 2 THEN p_retailprice END) AS area,
        CASE WHEN p_size > 2 THEN p_retailprice END AS largest_area,
        CASE WHEN l_linenumber <> 7 THEN l_quantity END AS f1, l_discount AS f2, nullif(l_tax, 0.03) AS f3,
        CAST(p_size AS DOUBLE) AS part_size
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""


@query("WITH " + DISCLOSED + """, e AS (
  SELECT *, coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) AS total FROM d)
SELECT type, count(*) AS n, count(DISTINCT id) AS entities, count(area) AS with_area,
       round(avg(largest_area / nullif(area, 0)), 6) AS use_share, round(sum(total), 2) AS total_fuel,
       CAST(count(*) FILTER (WHERE f1 IS NULL) AS BIGINT) AS quantity_missing,
       CAST(count(*) FILTER (WHERE f3 IS NULL) AS BIGINT) AS tax_missing,
       round(avg(coalesce(f1 / nullif(area, 0), 0)), 6) AS quantity_intensity,
       round(avg(coalesce(f2 / nullif(total, 0), 0)), 8) AS discount_share,
       round(avg(coalesce(coalesce(f3, 0) / nullif(total, 0), 0)), 8) AS tax_share
FROM e GROUP BY 1
""")  # fmt: skip
def engineered_features(spark, sf):
    frame, _ = D.engineer(disclosed(spark, sf), LAYOUT)
    return frame.groupBy(F.col(D.MODEL_TYPE).alias("type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(D.BUILDING_ID).alias("entities"),
        F.count(F.col(f"`{D.MODEL_AREA}`")).alias("with_area"),
        rounded(F.avg(D.USE_SHARE), 6).alias("use_share"),
        rounded(F.sum(f"`{D.TOTAL_FUEL}`"), 2).alias("total_fuel"),
        F.sum("quantity_missing").alias("quantity_missing"),
        F.sum("tax_missing").alias("tax_missing"),
        rounded(F.avg("quantity_intensity"), 6).alias("quantity_intensity"),
        rounded(F.avg("discount_share"), 8).alias("discount_share"),
        rounded(F.avg("tax_share"), 8).alias("tax_share"),
    )


@query("WITH " + DISCLOSED + """
SELECT CAST(year AS INTEGER) AS year, count(*) AS n, count(DISTINCT id) AS entities, round(avg(target), 4) AS mean_target
FROM d WHERE area IS NOT NULL AND target IS NOT NULL GROUP BY 1
""")  # fmt: skip
def modelling_rows(spark, sf):
    frame, _ = D.engineer(D.clean_anomalies(disclosed(spark, sf), LAYOUT), LAYOUT)
    return D.modelling_rows(frame, LAYOUT).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(D.BUILDING_ID).alias("entities"),
        rounded(F.avg("target")).alias("mean_target"),
    )


@query("WITH " + DISCLOSED + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE area IS NOT NULL) AS a,
  count(largest_area / nullif(area, 0)) AS s FROM d)
SELECT 'estimation_full' AS scenario, CAST(13 AS INTEGER) AS numeric_columns, CAST(1 AS INTEGER) AS categorical_columns,
       CAST(2 * n + a + s + 9 * n AS BIGINT) AS filled FROM c
UNION ALL SELECT 'estimation_without_intensities', 10, 1, CAST(2 * n + a + s + 6 * n AS BIGINT) FROM c
UNION ALL SELECT 'forecasting_strict', 4, 1, CAST(2 * n + a + s AS BIGINT) FROM c
UNION ALL SELECT 'fuel_derived_only', 9, 0, CAST(9 * n AS BIGINT) FROM c
""")  # fmt: skip
def feature_scenarios(spark, sf):
    """Columns of each feature set and how many of their numeric cells are filled."""
    frame, kinds = D.engineer(disclosed(spark, sf), LAYOUT)
    sets = D.scenarios(kinds)
    filled = frame.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c, kind in kinds.items() if kind != D.CATEGORY])
    rows = [
        F.struct(
            F.lit(name).alias("scenario"),
            F.lit(len(f.numeric)).alias("numeric_columns"),
            F.lit(len(f.categorical)).alias("categorical_columns"),
            sum([F.col(f"`{c}`") for c in f.numeric], F.lit(0)).cast("long").alias("filled"),
        )
        for name, f in sets.items()
    ]
    return filled.select(F.inline(F.array(*rows)))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'c' || o_custkey ELSE 'o' || o_orderkey END AS id FROM orders
""")
def stable_ids(spark, sf):
    orders = table(spark, sf, "orders").withColumns(
        {
            "id_1": F.when(F.col("o_orderstatus") == "F", F.lit("nan")).otherwise(F.concat(F.lit("c"), "o_custkey")),
            "id_2": F.concat(F.lit("o"), "o_orderkey"),
        }
    )
    return orders.select("o_orderkey", stable_id(orders, ["id_1", "absent", "id_2"]).alias("id"))


@query("""
WITH o AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'c' || o_custkey END AS id, o_orderpriority AS p, o_orderstatus AS s FROM orders),
n AS (SELECT p, s, count(*) AS n, count(*) > 1 AS many FROM o WHERE id IS NULL GROUP BY 1, 2)
SELECT p, s, count(*) AS n, count(DISTINCT id) AS ids, false AS numbered FROM o WHERE id IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT p, s, n, n, many FROM n
""")
def ids_of_equal_rows(spark, sf):
    """Rows without an id keep apart, though many are alike; rows with an id share it."""
    orders = table(spark, sf, "orders")
    own = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("c"), F.col("o_custkey")))
    rows = orders.select(own.alias("id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    found = with_row_id(rows, ["id"], "row_id")
    return found.groupBy("p", "s").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("row_id").alias("ids"),
        F.bool_or(F.col("row_id").rlike("^row_[0-9A-F]+_[0-9]+$")).alias("numbered"),
    )


@query("""
SELECT trim(regexp_replace(replace(replace(replace(lower(x), '(kbtu)', ''), '(ft²)', ''), 'use', ''),
                           '[^a-z0-9]+', '_', 'g'), '_') AS slug, count(*) AS n
FROM (SELECT p_type || ' Use - ' || p_brand || ' (kBtu)' AS x FROM part) GROUP BY 1
""")
def name_slugs(spark, sf):
    name = F.concat("p_type", F.lit(" Use - "), "p_brand", F.lit(" (kBtu)"))
    named = table(spark, sf, "part").select(slug_column(name).alias("slug"))
    return named.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


_FILLED = """
WITH d AS (SELECT doc_id, nullif(lang, 'de') AS lang, CASE WHEN quality IS NOT NULL THEN n_chars END AS x
           FROM documents LEFT JOIN labels USING (doc_id))
"""


def _documents_with_gaps(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id",
        F.nullif("lang", F.lit("de")).alias("lang"),
        F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("x"),
    )


@query(_FILLED + """, g AS (SELECT lang, median(x) AS m FROM d WHERE lang IS NOT NULL GROUP BY 1)
SELECT doc_id, round(coalesce(x, m, (SELECT median(x) FROM d)), 4) AS x FROM d LEFT JOIN g USING (lang)
""")  # fmt: skip
def group_median_fill(spark, sf):
    docs = _documents_with_gaps(spark, sf)
    filled = GroupMedianFill(inputCols=["x"], groupCol="lang").fit(docs).transform(docs)
    return filled.select("doc_id", rounded("x").alias("x"))


@query(_FILLED + """
SELECT doc_id, round(coalesce(x, (SELECT median(x) FROM d WHERE doc_id % 5 <> 0)), 4) AS x FROM d
""")
def median_fill(spark, sf):
    """Fitted on the training rows, applied to all."""
    docs = _documents_with_gaps(spark, sf)
    model = MedianFill(inputCols=["x"]).fit(docs.where(F.col("doc_id") % 5 != 0))
    return model.transform(docs).select("doc_id", rounded("x").alias("x"))


@query("""
WITH e AS (SELECT nullif(event_type, 'error') AS t FROM events),
m AS (SELECT t FROM e WHERE t IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, t LIMIT 1)
SELECT coalesce(e.t, (SELECT t FROM m)) AS event_type, count(*) AS n FROM e GROUP BY 1
""")
def mode_fill(spark, sf):
    events = table(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type"))
    filled = ModeFill(inputCols=["event_type"]).fit(events).transform(events)
    return filled.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_BRANDS = """
WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS b, p_type AS t FROM part),
k AS (SELECT b FROM p WHERE p_partkey % 5 <> 0 AND b IS NOT NULL GROUP BY 1
      HAVING count(*) >= (SELECT count(*) * 0.03 FROM part))
"""


def _brands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"), "p_type")


@query(_BRANDS + """
SELECT CASE WHEN p.b IS NULL THEN 'Missing' WHEN k.b IS NULL THEN 'Other' ELSE p.b END AS label, count(*) AS n
FROM p LEFT JOIN k ON p.b = k.b GROUP BY 1
""")
def rare_groups(spark, sf):
    parts = _brands(spark, sf)
    least = -(-parts.count() * 3 // 100)
    grouper = RareGrouper(inputCols=["p_brand"], outputCols=["label"], minCount=least)
    model = grouper.fit(parts.where(F.col("p_partkey") % 5 != 0))
    return model.transform(parts).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 5 <> 0 AND p_type NOT IN ('PROMO', 'SMALL'))
SELECT c.p_type AS category, CAST(count(p.p_type) AS DOUBLE) AS ones, (SELECT count(*) FROM part) AS rows_encoded
FROM c LEFT JOIN part p ON p.p_type = c.p_type AND p.p_type <> 'SMALL' GROUP BY 1
""")
def one_hot(spark, sf):
    """Encoder fitted without PROMO; unseen (PROMO) and missing (SMALL) become all zeros."""
    parts = table(spark, sf, "part").select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("p_type"))
    seen = parts.where((F.col("p_partkey") % 5 != 0) & (F.col("p_type") != "PROMO"))
    encoder = CategoryCoder(inputCols=["p_type"], outputCols=["hot"]).fit(seen)
    total = encoder.transform(parts).agg(Summarizer.sum(F.col("hot")).alias("s"))
    slots = total.select(F.posexplode(vector_to_array("s")).alias("place", "ones"))
    labels = encoder.table.select(F.col("v").alias("category"), "place")
    return labels.join(slots, "place").select("category", "ones", F.lit(parts.count()).cast("long").alias("rows_encoded"))


@query("""
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer))
                        / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z,
       0.0::DOUBLE AS constant_z, round(c_acctbal, 4) AS back
FROM customer
""")
def scale_population(spark, sf):
    customers = table(spark, sf, "customer").withColumn("five", F.lit(5.0))
    scaler = PopulationScaler(inputCols=["c_acctbal", "five"], outputCols=["z", "constant_z"]).fit(customers)
    scaled = scaler.transform(customers).withColumns({"z_kept": F.col("z"), "constant_kept": F.col("constant_z")})
    back = scaler.inverse(scaled)
    return back.select(
        "c_custkey", rounded("z_kept", 6).alias("z"), F.col("constant_kept").alias("constant_z"), rounded("z").alias("back")
    )
