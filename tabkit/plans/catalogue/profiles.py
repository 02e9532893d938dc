"""Profiles of tables, columns and categories."""

from pyspark.sql import functions as F

from tabkit.functions.coerce import placeholder_to_null
from tabkit.operators import profile as P
from tabkit.operators.quantiles import quantiles
from tabkit.operators.reshape import transpose
from tabkit.plans.registry import query, rounded, table


def labelled_documents(spark, sf):
    """Documents with their labels; most labels are missing."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@query("SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns FROM lineitem")
def table_shape(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


@query("""
SELECT 'bigint' AS data_type, 1 AS is_numeric, CAST(3 AS BIGINT) AS n_columns,
       count(l_orderkey) + count(l_partkey) + count(l_suppkey) AS filled_cells FROM lineitem
UNION ALL SELECT 'int', 1, 1, count(l_linenumber) FROM lineitem
UNION ALL SELECT 'double', 1, 4, count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(l_tax)
  FROM lineitem
UNION ALL SELECT 'string', 0, 2, count(l_returnflag) + count(l_linestatus) FROM lineitem
UNION ALL SELECT 'timestamp_ntz', 0, 1, count(l_shipdate) FROM lineitem
""")
def type_histogram(spark, sf):
    return P.type_histogram(table(spark, sf, "lineitem"))


@query("""
SELECT 'keys' AS family, CAST(3 AS BIGINT) AS n_columns,
       count(l_orderkey) + count(l_partkey) + count(l_suppkey) AS filled_cells FROM lineitem
UNION ALL SELECT 'money', 3, count(l_extendedprice) + count(l_discount) + count(l_tax) FROM lineitem
UNION ALL SELECT 'state', 2, count(l_returnflag) + count(l_linestatus) FROM lineitem
UNION ALL SELECT 'order', 1, count(l_orderkey) FROM lineitem
""")
def column_families(spark, sf):
    families = {
        "keys": ["key"],
        "money": ["price", "discount", "tax"],
        "state": ["flag", "status"],
        "order": ["order"],
        "water": ["water"],
    }
    return P.column_families(table(spark, sf, "lineitem"), families)


@query("SELECT 'event_type' AS column_name, count(*) AS n FROM events WHERE event_type = 'error'")
def placeholder_counts(spark, sf):
    return P.placeholder_counts(table(spark, sf, "events"), "error")


@query("""
SELECT nullif(event_type, 'error') AS category, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM events), 6) AS proportion
FROM events GROUP BY 1
""")
def category_share(spark, sf):
    events = placeholder_to_null(table(spark, sf, "events"), "error")
    return P.category_share(events, "event_type").withColumn("proportion", rounded("proportion", 6))


@query("""
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS column_name, count(*) - count(quality) AS missing_count,
       round((count(*) - count(quality)) / count(*), 6) AS missing_rate FROM d
UNION ALL SELECT 'toxic', count(*) - count(toxic), round((count(*) - count(toxic)) / count(*), 6) FROM d
UNION ALL SELECT 'lang', count(*) - count(lang), round((count(*) - count(lang)) / count(*), 6) FROM d
UNION ALL SELECT 'text', count(*) - count(text), round((count(*) - count(text)) / count(*), 6) FROM d
""")
def missing_profile(spark, sf):
    found = P.missing_profile(labelled_documents(spark, sf), ["quality", "toxic", "lang", "text"])
    return found.withColumn("missing_rate", rounded("missing_rate", 6))


@query("""
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS column_name, 'int' AS data_type, count(*) - count(quality) AS missing_count,
       round((count(*) - count(quality)) / count(*), 6) AS missing_rate, count(DISTINCT quality) AS n_unique FROM d
UNION ALL SELECT 'lang', 'string', 0, 0.0, count(DISTINCT lang) FROM d
UNION ALL SELECT 'text', 'string', 0, 0.0, count(DISTINCT text) FROM d
UNION ALL SELECT 'n_chars', 'bigint', 0, 0.0, count(DISTINCT n_chars) FROM d
""")
def column_profile(spark, sf):
    docs = labelled_documents(spark, sf).withColumn("quality", F.col("quality").cast("int"))
    found = P.column_profile(docs, ["quality", "lang", "text", "n_chars"])
    return found.withColumn("missing_rate", rounded("missing_rate", 6))


@query("SELECT count(*) - count(DISTINCT (text, lang)) AS duplicate_rows FROM documents")
def duplicate_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
        round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS max, count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) / count(*), 6) AS missing_rate
        FROM (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem)"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
))
def describe_numeric(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    found = P.describe(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return found.withColumns(
        {c: rounded(c) for c in ("mean", "std", "p25", "p50", "p75")} | {"missing_rate": rounded("missing_rate", 6)}
    )


@query(" UNION ALL ".join(
    f"SELECT '{m}' AS measure, round(max(CASE WHEN c = 'l_quantity' THEN {m} END), 4) AS l_quantity,"
    f" round(max(CASE WHEN c = 'l_tax' THEN {m} END), 4) AS l_tax FROM s"
    if i else
    "WITH s AS (SELECT 'l_quantity' AS c, CAST(count(l_quantity) AS DOUBLE) AS n, avg(l_quantity) AS mean,"
    " stddev(l_quantity) AS std, median(l_quantity) AS p50 FROM lineitem UNION ALL"
    " SELECT 'l_tax', count(l_tax), avg(l_tax), stddev(l_tax), median(l_tax) FROM lineitem) "
    f"SELECT '{m}' AS measure, round(max(CASE WHEN c = 'l_quantity' THEN {m} END), 4) AS l_quantity,"
    f" round(max(CASE WHEN c = 'l_tax' THEN {m} END), 4) AS l_tax FROM s"
    for i, m in enumerate(("n", "mean", "std", "p50"))
))
def describe_transposed(spark, sf):
    found = P.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    turned = transpose(found, "column_name", ["n", "mean", "std", "p50"], ["l_quantity", "l_tax"], "measure")
    return turned.withColumns({c: rounded(c) for c in ("l_quantity", "l_tax")})


@query("""
SELECT count(n_chars) AS n, round(avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
       count(*) FILTER (WHERE n_chars <= 0) AS nonpositive_count, round(skewness(n_chars), 6) AS skew,
       CAST(max(n_chars) AS DOUBLE) AS max, round(quantile_cont(n_chars, 0.99), 4) AS p99,
       round(quantile_cont(n_chars, 0.999), 6) AS p999
FROM documents
""")
def target_profile(spark, sf):
    found = P.target_profile(table(spark, sf, "documents"), "n_chars")
    return found.withColumns(
        {"missing_rate": rounded("missing_rate", 6), "skew": rounded("skew", 6), "p99": rounded("p99"), "p999": rounded("p999", 6)}
    )


@query("""
SELECT count(c_acctbal) AS n, round(avg(CASE WHEN c_acctbal IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
       count(*) FILTER (WHERE c_acctbal <= 0) AS nonpositive_count, round(skewness(c_acctbal), 6) AS skew,
       max(c_acctbal) AS max, round(quantile_cont(c_acctbal, 0.99), 4) AS p99,
       round(quantile_cont(c_acctbal, 0.999), 6) AS p999
FROM customer
""")
def target_profile_signed(spark, sf):
    found = P.target_profile(table(spark, sf, "customer"), "c_acctbal")
    return found.withColumns(
        {"missing_rate": rounded("missing_rate", 6), "skew": rounded("skew", 6), "p99": rounded("p99"), "p999": rounded("p999", 6)}
    )


@query("SELECT nullif(lang, 'de') AS category, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY 1")
def category_counts(spark, sf):
    docs = table(spark, sf, "documents").withColumn("lang", F.nullif("lang", F.lit("de")))
    return P.category_counts(docs, "lang")


@query("""
SELECT count(DISTINCT nullif(p_brand, 'Brand#1')) AS n_brands, count(DISTINCT p_type) AS n_types FROM part
""")
def distinct_categories(spark, sf):
    part = table(spark, sf, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#1")))
    return part.agg(F.count_distinct("p_brand").alias("n_brands"), F.count_distinct("p_type").alias("n_types"))


@query("""
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.01), 4) AS p01,
       round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.995), 6) AS p995,
       max(o_totalprice) AS p100
FROM orders GROUP BY 1
""")
def quantile_ladder(spark, sf):
    wanted = {
        "p01": ("o_totalprice", 0.01),
        "p50": ("o_totalprice", 0.5),
        "p995": ("o_totalprice", 0.995),
        "p100": ("o_totalprice", 1.0),
    }
    found = quantiles(table(spark, sf, "orders"), wanted, by=["o_orderpriority"])
    return found.withColumns({"p01": rounded("p01"), "p50": rounded("p50"), "p995": rounded("p995", 6)})


@query("""
SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(quantile_cont(l_quantity, 0.9), 4) AS q90
FROM lineitem
""")
def quantile_selection(spark, sf):
    """The route for large tables: ranks are selected by narrowing, no value map is built."""
    wanted = {
        "p01": ("l_extendedprice", 0.01),
        "p50": ("l_extendedprice", 0.5),
        "p99": ("l_extendedprice", 0.99),
        "q90": ("l_quantity", 0.9),
    }
    found = quantiles(table(spark, sf, "lineitem"), wanted, small_rows=0)
    return found.select(*[rounded(c).alias(c) for c in wanted])


@query("""
SELECT event_type, CAST(NULL AS DOUBLE) AS none, round(quantile_cont(v, 0.5), 4) AS mid, quantile_cont(w, 0.9) AS high
FROM (SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS v,
        CASE WHEN event_id % 2 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS w FROM events)
WHERE event_type IS NOT NULL GROUP BY 1
""")
def quantiles_without_values(spark, sf):
    """The route for large tables: an empty column, a group without values, infinite values."""
    events = table(spark, sf, "events").select(
        "event_type",
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
        F.when(F.col("event_id") % 2 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("w"),
    )
    wanted = {"none": ("empty", 0.5), "mid": ("v", 0.5), "high": ("w", 0.9)}
    found = quantiles(events, wanted, by=["event_type"], small_rows=0)
    return found.withColumn("mid", rounded("mid"))


_CORR = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "nullif(l_discount, 0)", "tax": "l_tax"}


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({x}, {y}), 6) AS r FROM lineitem"
    for a, x in _CORR.items() for b, y in _CORR.items()
))
def correlation_matrix(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    labels = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax"}
    found = P.correlation_matrix(lines, list(labels), labels)
    # Near 0 the sign of a rounded value is noise.
    return found.withColumn("r", rounded("r", 6) + F.lit(0.0))


@query("""
WITH d AS (SELECT quality = toxic AS same FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) FILTER (WHERE same) AS same_count, count(*) - count(*) FILTER (WHERE same) AS different_count,
       round(count(*) FILTER (WHERE same) / count(*), 6) AS same_rate,
       round((count(*) - count(*) FILTER (WHERE same)) / count(*), 6) AS different_rate
FROM d
""")
def agreement_rate(spark, sf):
    found = P.agreement(labelled_documents(spark, sf), "quality", "toxic")
    return found.withColumns({c: rounded(c, 6) for c in ("same_rate", "different_rate")})


@query("""
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 40.0) AS INTEGER), 39) AS bin, count(*) AS n
      FROM events, e GROUP BY 1),
b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(40))
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 40), 6) AS left_edge,
       round(lo + (b.bin + 1) * ((hi - lo) / 40), 6) AS right_edge, coalesce(c.n, 0) AS n
FROM b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin
""")
def histogram(spark, sf):
    found = P.histogram(table(spark, sf, "events"), "value", 40)
    return found.withColumns({c: rounded(c, 6) for c in ("left_edge", "right_edge")})


_BOX = """
WITH v AS ({rows}), q AS (
  SELECT {key} quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM v {group})
SELECT {key} count(*) AS n, round(max(q1), 4) AS q1, round(max(median), 4) AS median, round(max(q3), 4) AS q3,
       min(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
       max(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
       count(*) FILTER (WHERE NOT (x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)) AS outliers
FROM v {join} {group}
"""


@query(_BOX.format(
    rows="SELECT event_type, value AS x FROM events WHERE event_type <> 'error'",
    key="event_type,", group="GROUP BY event_type", join="JOIN q USING (event_type)",
))
def box_stats(spark, sf):
    events = placeholder_to_null(table(spark, sf, "events"), "error")
    found = P.box_stats(events, "value", by=["event_type"])
    return found.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query(_BOX.format(
    rows="SELECT CAST(n_chars AS DOUBLE) AS x FROM documents", key="", group="", join="CROSS JOIN q"
))
def box_stats_overall(spark, sf):
    found = P.box_stats(table(spark, sf, "documents"), "n_chars")
    return found.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})
