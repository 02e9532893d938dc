"""Bands, bins, ranks and deciles."""

from pyspark.sql import functions as F

from tabkit.functions.bands import SIZE_LABELS, band_table, fixed_bands, quantile_bands
from tabkit.operators.ranks import assign_deciles, rank_rows
from tabkit.plans.registry import query, rounded, table

_EDGES = [0.0, 10.0, 25.0, 45.0]
_LABELS = ["1-10", "11-25", "26-45"]


@query("""
SELECT CASE WHEN x < 0 THEN NULL WHEN x <= 10 THEN '1-10' WHEN x <= 25 THEN '11-25' WHEN x <= 45 THEN '26-45' END
       AS band, count(*) AS n, min(x) AS lowest, max(x) AS highest
FROM (SELECT CASE WHEN l_linenumber <> 2 THEN l_quantity END AS x FROM lineitem) GROUP BY 1
""")
def fixed_band_counts(spark, sf):
    x = F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))
    lines = table(spark, sf, "lineitem").withColumn("x", x)
    banded = lines.withColumn("band", fixed_bands("x", _EDGES, _LABELS))
    return banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lowest"), F.max("x").alias("highest")
    )


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
                  quantile_cont(o_totalprice, 0.75) AS c FROM orders),
s AS (SELECT CASE WHEN o_totalprice <= a THEN 'Small' WHEN o_totalprice <= b THEN 'Medium'
                  WHEN o_totalprice <= c THEN 'Large' ELSE 'Very Large' END AS size_bin, o_totalprice FROM orders, q)
SELECT size_bin, count(*) AS n, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM s GROUP BY 1
""")
def size_bins(spark, sf):
    binned = quantile_bands(table(spark, sf, "orders"), "o_totalprice", "size_bin")
    return binned.groupBy("size_bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest")
    )


@query("""
WITH q AS (SELECT quantile_cont(l_discount, 0.25) AS a, quantile_cont(l_discount, 0.5) AS b,
                  quantile_cont(l_discount, 0.75) AS c FROM lineitem),
s AS (SELECT CASE WHEN l_discount <= a THEN 'Small' WHEN l_discount <= b THEN 'Medium'
                  WHEN l_discount <= c THEN 'Large' ELSE 'Very Large' END AS size_bin FROM lineitem, q),
b AS (SELECT * FROM (VALUES (1, 'Small'), (2, 'Medium'), (3, 'Large'), (4, 'Very Large')) t(band_order, size_bin))
SELECT b.band_order, b.size_bin, count(s.size_bin) AS n FROM b LEFT JOIN s USING (size_bin) GROUP BY ALL
""")
def size_bins_of_ties(spark, sf):
    """Few distinct values; every bin stays in the report, also an empty one."""
    lines = table(spark, sf, "lineitem").select("l_discount")
    counts = quantile_bands(lines, "l_discount", "size_bin").groupBy("size_bin").agg(F.count(F.lit(1)).alias("n"))
    every = band_table(spark, SIZE_LABELS, "size_bin")
    return every.join(counts, "size_bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


_DECILES = """
WITH r AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}, {key}) AS rn,
                  count({value}) OVER () AS n FROM {rows} WHERE {value} IS NOT NULL)
SELECT 'Decile ' || CAST(greatest(1, ((rn - 1) * 10 + (n - 2)) // (n - 1)) AS VARCHAR) AS decile,
       count(*) AS n, min(v) AS lowest, max(v) AS highest, round(sum(v), 2) AS total
FROM r GROUP BY 1
"""


def _decile_report(df, value):
    return df.where(F.col(value).isNotNull()).groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        rounded(F.sum(value), 2).alias("total"),
    )


@query(_DECILES.format(value="o_totalprice", key="o_orderkey", rows="orders"))
def deciles(spark, sf):
    orders = assign_deciles(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", "decile", "Decile")
    return _decile_report(orders, "o_totalprice")


@query(_DECILES.format(
    value="v", key="event_id",
    rows="(SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('view', 'click') THEN 1.5 "
    "ELSE value END AS v FROM events)",
))
def deciles_by_selection(spark, sf):
    """The route for large tables, on a column where one value holds over a third of the rows."""
    value = (
        F.when(F.col("event_type") == "error", None)
        .when(F.col("event_type").isin("view", "click"), 1.5)
        .otherwise(F.col("value"))
    )
    events = table(spark, sf, "events").withColumn("v", value)
    return _decile_report(assign_deciles(events, "v", "event_id", "decile", "Decile", small_rows=0), "v")


@query("""
SELECT c_custkey, CASE WHEN c_nationkey <> 5 THEN row_number() OVER (
         ORDER BY CASE WHEN c_nationkey <> 5 THEN round(c_acctbal / 100) END NULLS LAST, c_custkey) END AS rn
FROM customer
""")
def ranks_with_ties(spark, sf):
    value = F.when(F.col("c_nationkey") != 5, F.round(F.col("c_acctbal") / 100))
    customers = table(spark, sf, "customer").withColumn("v", value)
    return rank_rows(customers, "v", "c_custkey").select("c_custkey", "rn")


@query(_DECILES.format(value="v", key="k", rows="(SELECT round(l_quantity) AS v, l_orderkey * 1000000000000 + l_linenumber AS k FROM lineitem)"))
def deciles_large_keys(spark, sf):
    """Ties are split by keys far beyond 2^53, where neighbours are equal as doubles."""
    key = F.col("l_orderkey") * F.lit(1_000_000_000_000) + F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(F.round("l_quantity").alias("v"), key.alias("k"))
    return _decile_report(assign_deciles(lines, "v", "k", "decile", "Decile", small_rows=0), "v")


@query(_DECILES.format(value="p_size", key="k", rows="(SELECT CAST(p_size AS DOUBLE) AS p_size, p_name || p_partkey AS k FROM part)"))
def deciles_text_keys(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("p_size"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("k"))
    return _decile_report(assign_deciles(parts, "p_size", "k", "decile", "Decile", small_rows=0), "p_size")


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY round(l_quantity), l_orderkey * 1000000000000 + l_linenumber) AS rn
FROM lineitem WHERE l_quantity IS NOT NULL
""")
def ranks_over_ranges(spark, sf):
    """Few values with many ties each, numbered over all ranges."""
    key = F.col("l_orderkey") * F.lit(1_000_000_000_000) + F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_quantity").alias("v"), key.alias("k"))
    return rank_rows(lines, "v", "k").where("v IS NOT NULL").select("l_orderkey", "l_linenumber", "rn")
