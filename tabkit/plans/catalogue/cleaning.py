"""Coercion, domain rules, filters, caps, top-k and samples."""

from pyspark.sql import functions as F

from tabkit.functions.coerce import NULL_TOKENS, nan_to_null, to_number, to_number_lenient
from tabkit.functions.numbers import clip, skew
from tabkit.operators import clean as C
from tabkit.operators.models import cap_sensitivity as caps
from tabkit.operators.profile import box_stats, rows_in_top, sparse_columns, top_categories
from tabkit.plans.catalogue.profiles import labelled_documents
from tabkit.plans.registry import query, rounded, slot_of, table


def _number_report(df, key, column):
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(column).alias("n"),
        rounded(F.sum(column), 2).alias("total"),
        F.min(column).alias("lowest"),
        F.max(column).alias("highest"),
    )


@query("""
SELECT l_returnflag, count(*) AS n_rows, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total,
       min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
FROM lineitem GROUP BY 1
""")
def numeric_coercion(spark, sf):
    lines = table(spark, sf, "lineitem")
    text = lines.withColumn("price", F.format_number("l_extendedprice", 2))
    return _number_report(text.withColumn("price", to_number("price")), "l_returnflag", "price")


@query("""
SELECT event_type, count(*) AS n_rows, count(v) AS n, round(sum(v), 2) AS total, min(v) AS lowest, max(v) AS highest
FROM (SELECT event_type, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS v FROM events) GROUP BY 1
""")
def numeric_coercion_tokens(spark, sf):
    events = table(spark, sf, "events")
    text = (
        F.when(F.col("event_type") == "error", "Not Available")
        .when(F.col("event_type") == "view", F.concat(F.col("value").cast("string"), F.lit("d")))
        .otherwise(F.col("value").cast("string"))
    )
    return _number_report(events.withColumn("v", to_number(text, NULL_TOKENS)), "event_type", "v")


@query("""
SELECT l_linestatus, count(*) AS n_rows, count(v) AS n, round(sum(v), 2) AS total, min(v) AS lowest, max(v) AS highest
FROM (SELECT l_linestatus, CASE WHEN l_linenumber < 7 THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1
""")
def numeric_coercion_lenient(spark, sf):
    text = F.concat(F.lit("  ca. "), F.format_number("l_extendedprice", 2), F.lit(" kBtu "))
    text = F.regexp_replace(text, r"ca\.", "ca")
    text = F.when(F.col("l_linenumber") == 7, F.lit(" None ")).otherwise(text)
    lines = table(spark, sf, "lineitem").withColumn("v", to_number_lenient(text))
    return _number_report(lines, "l_linestatus", "v")


@query("""
SELECT event_type, count(*) AS n_rows, count(v) AS n, round(sum(v), 2) AS total, min(v) AS lowest, max(v) AS highest
FROM (SELECT event_type, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) GROUP BY 1
""")
def nan_as_missing(spark, sf):
    value = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, sf, "events").withColumn("v", nan_to_null(value))
    return _number_report(events, "event_type", "v")


@query("""
SELECT l_returnflag, count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 40) AS quantity,
       count(*) FILTER (WHERE l_discount > 0) AS discount, count(*) FILTER (WHERE l_tax >= 0.02) AS tax,
       count(*) FILTER (WHERE l_extendedprice <= 50000) AS price,
       round(avg(CASE WHEN l_quantity BETWEEN 5 AND 40 THEN l_quantity END), 4) AS mean_quantity
FROM lineitem GROUP BY 1
""")
def domain_rules(spark, sf):
    rules = [
        C.Domain("l_quantity", at_least=5, at_most=40),
        C.Domain("l_discount", above=0),
        C.Domain("l_tax", at_least=0.02),
        C.Domain("l_extendedprice", at_most=50000),
        C.Domain("not_there", above=0),
    ]
    return (
        C.apply_domains(table(spark, sf, "lineitem"), rules)
        .groupBy("l_returnflag")
        .agg(
            F.count("l_quantity").alias("quantity"),
            F.count("l_discount").alias("discount"),
            F.count("l_tax").alias("tax"),
            F.count("l_extendedprice").alias("price"),
            rounded(F.avg("l_quantity")).alias("mean_quantity"),
        )
    )


@query("""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) AS rows_kept,
       round_even(count(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) / count(*) * 100, 2) AS retention_pct
FROM lineitem
""")
def retention_rate(spark, sf):
    keep = (F.col("l_discount") > 0) & (F.col("l_tax") > 0)
    return C.retention(table(spark, sf, "lineitem"), keep)


@query("""
SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS lowest, round(sum(c_acctbal), 2) AS total
FROM customer WHERE c_acctbal > 0 AND c_nationkey > 0 GROUP BY 1
""")
def positive_rows(spark, sf):
    kept = C.positive_rows(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return kept.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("c_acctbal").alias("lowest"),
        rounded(F.sum("c_acctbal"), 2).alias("total"),
    )


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1
""")
def year_filter(spark, sf):
    """A year as a date range, which the scan can use to skip row groups."""
    day = F.col("o_orderdate")
    orders = table(spark, sf, "orders").where(
        (day >= F.lit("1998-01-01").cast("timestamp_ntz")) & (day < F.lit("1999-01-01").cast("timestamp_ntz"))
    )
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total")
    )


@query("""
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1
""")
def drop_missing(spark, sf):
    kept = labelled_documents(spark, sf).dropna(subset=["quality", "toxic"])
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH b AS (SELECT quantile_cont(n_chars, 0.99) AS p99 FROM documents)
SELECT count(*) AS n, max(n_chars) AS largest, round(skewness(n_chars), 6) AS skew, round(max(p99), 4) AS p99
FROM documents, b WHERE n_chars > 0 AND n_chars <= p99
""")
def cap_filter(spark, sf):
    kept, bound = C.cap_rows(table(spark, sf, "documents"), "n_chars", 0.99)
    return kept.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("n_chars").alias("largest"),
        rounded(skew("n_chars"), 6).alias("skew"),
    ).withColumn("p99", rounded(F.lit(bound)))


@query(" UNION ALL ".join(
    f"""SELECT '{name}' AS target_filter, {bound} AS upper_bound, count(*) AS n_rows, max(value) AS largest
        FROM events, (SELECT quantile_cont(value, {q}) AS b FROM events) WHERE value > 0 AND value <= b"""
    for name, q, bound in (
        ("P95", 0.95, "round(max(b), 4)"), ("P99", 0.99, "round(max(b), 4)"), ("NoUpperCap", 1.0, "CAST(NULL AS DOUBLE)")
    )
))
def cap_sensitivity(spark, sf):
    found = caps(table(spark, sf, "events"), "value", {"P95": 0.95, "P99": 0.99, "NoUpperCap": None})
    return found.withColumn("upper_bound", rounded("upper_bound"))


@query("""
WITH b AS (SELECT quantile_cont(n_chars, 0.01) AS lo, quantile_cont(n_chars, 0.99) AS hi FROM documents)
SELECT doc_id, round(greatest(least(n_chars, hi), lo), 4) AS n_chars_wins,
       round(ln(1 + greatest(least(n_chars, hi), lo)), 6) AS log_chars,
       round(exp(ln(1 + greatest(least(n_chars, hi), lo))) - 1, 4) AS back
FROM documents, b
""")
def winsorize(spark, sf):
    found = C.winsorize(table(spark, sf, "documents"), {"n_chars": "n_chars_wins"})
    return found.select(
        "doc_id",
        rounded("n_chars_wins").alias("n_chars_wins"),
        rounded(F.log1p("n_chars_wins"), 6).alias("log_chars"),
        rounded(F.expm1(F.log1p("n_chars_wins"))).alias("back"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE greatest(least(c_acctbal, 9000.0), 0.0) END AS clipped
FROM customer
""")
def clip_keeps_missing(spark, sf):
    balance = F.when(F.col("c_nationkey") != 3, F.col("c_acctbal"))
    customers = table(spark, sf, "customer").withColumn("balance", balance)
    return customers.select("c_custkey", clip("balance", 0.0, 9000.0).alias("clipped"))


@query("""
SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10
""")
def top_brands(spark, sf):
    return top_categories(table(spark, sf, "part"), "p_brand", 10)


@query("""
WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10),
v AS (SELECT p_brand, p_retailprice AS x FROM part WHERE p_brand IN (SELECT p_brand FROM t)),
q AS (SELECT p_brand, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
SELECT p_brand, count(*) AS n, round(max(q1), 4) AS q1, round(max(median), 4) AS median, round(max(q3), 4) AS q3,
       min(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
       max(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
       count(*) FILTER (WHERE NOT (x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)) AS outliers
FROM v JOIN q USING (p_brand) GROUP BY 1
""")
def top_brand_boxes(spark, sf):
    found = box_stats(rows_in_top(table(spark, sf, "part"), "p_brand", 10), "p_retailprice", by=["p_brand"])
    return found.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query("""
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
ORDER BY o_totalprice DESC, o_orderstatus, o_orderkey LIMIT 20
""")
def top_orders(spark, sf):
    found = C.top_rows(
        table(spark, sf, "orders"), 20, F.desc("o_totalprice"), F.asc("o_orderstatus"), F.asc("o_orderkey")
    )
    return found.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def preview(spark, sf):
    return C.top_rows(table(spark, sf, "events"), 5, F.asc("event_id")).select("event_id", "event_type", "value")


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderkey * 2654435761) % 1000003, o_orderkey LIMIT 500
""")
def seeded_sample(spark, sf):
    found = C.sample_rows(table(spark, sf, "orders"), 500, "o_orderkey", order=slot_of("o_orderkey", 1000003))
    return found.select("o_orderkey", "o_totalprice")


@query("""
SELECT count(*) AS n_rows, CAST(count(lang) AS BIGINT) AS lang, CAST(count(n_chars) AS BIGINT) AS n_chars
FROM documents LEFT JOIN labels USING (doc_id)
""")
def sparse_columns_dropped(spark, sf):
    """Columns with more than half of their cells missing are dropped; the rest are counted."""
    docs = labelled_documents(spark, sf).select("doc_id", "lang", "n_chars", "quality", "toxic")
    kept = docs.drop(*sparse_columns(docs, 0.5, ["lang", "n_chars", "quality", "toxic"]), "never_there")
    return kept.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in kept.columns if c != "doc_id"]
    )
