"""Train / test roles and the training scope."""

from pyspark.sql import functions as F

from tabkit.operators.split import entity_role, random_role, scope, year_role
from tabkit.plans.registry import query, rounded, slot_of, table


def _by_role(df):
    return df.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_custkey").alias("entities"),
        rounded(F.avg("o_totalprice")).alias("mean_price"),
    )


_BY_ROLE = "role, count(*) AS n, count(DISTINCT o_custkey) AS entities, round(avg(o_totalprice), 4) AS mean_price"


@query(f"""
SELECT {_BY_ROLE} FROM (SELECT *, CASE WHEN (o_orderkey * 2654435761) % 10000 < 2000 THEN 'test' ELSE 'train' END
                        AS role FROM orders) GROUP BY role
""")
def random_split(spark, sf):
    return _by_role(random_role(table(spark, sf, "orders"), "o_orderkey", slot=slot_of("o_orderkey")))


@query(f"""
SELECT {_BY_ROLE} FROM (SELECT *, CASE WHEN (o_orderkey * 2654435761) % 10000 < 2000 THEN 'test'
  WHEN (o_orderkey * 40503) % 10000 < 2000 THEN 'validation' ELSE 'train' END AS role FROM orders) GROUP BY role
""")
def nested_split(spark, sf):
    """A validation part inside the training part."""
    outer = random_role(table(spark, sf, "orders"), "o_orderkey", slot=slot_of("o_orderkey"))
    inner = random_role(
        outer, "o_orderkey", slot=F.pmod(F.col("o_orderkey") * F.lit(40503), F.lit(10_000)), out="inner"
    )
    role = F.when((F.col("role") == "train") & (F.col("inner") == "test"), "validation").otherwise(F.col("role"))
    return _by_role(inner.withColumn("role", role))


@query(f"""
SELECT {_BY_ROLE} FROM (SELECT *, CASE WHEN year(o_orderdate) < 2000 THEN 'train' WHEN year(o_orderdate) = 2000
  THEN 'test' END AS role FROM orders) WHERE role IS NOT NULL GROUP BY role
""")
def year_holdout(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return _by_role(year_role(orders, "year", 2000))


@query(f"""
SELECT {_BY_ROLE} FROM (SELECT *, CASE WHEN year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM orders)
  THEN 'train' ELSE 'test' END AS role FROM orders) GROUP BY role
""")
def latest_year_holdout(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return _by_role(year_role(orders, "year"))


@query("""
WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'row|' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS e,
  (CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_custkey END * 2654435761) % 10000 < 2000 AS held FROM orders),
s AS (SELECT e, count(DISTINCT held) AS sides FROM r GROUP BY 1)
SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS role, count(*) AS n, count(DISTINCT r.e) AS entities,
       count(*) FILTER (WHERE sides > 1) AS rows_on_both_sides
FROM r JOIN s USING (e) GROUP BY 1
""")
def entity_holdout(spark, sf):
    """A third of the orders have no entity: each is one of its own."""
    entity = F.when(F.col("o_orderstatus") != "F", F.col("o_custkey"))
    orders = table(spark, sf, "orders").withColumn("entity", entity)
    own = F.coalesce("entity", "o_orderkey")
    ranked = entity_role(orders, "entity", "o_orderkey", slot=slot_of(own))
    named = ranked.withColumn(
        "e", F.coalesce(F.col("entity").cast("string"), F.concat(F.lit("row|"), "o_orderkey"))
    )
    sides = named.groupBy("e").agg(F.count_distinct("role").alias("sides"))
    return named.join(sides, "e").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("e").alias("entities"),
        F.count_if(F.col("sides") > 1).alias("rows_on_both_sides"),
    )


@query("""
WITH r AS (SELECT o_totalprice AS y, CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS role
           FROM orders WHERE year(o_orderdate) <= 2000),
b AS (SELECT quantile_cont(y, 0.99) AS bound FROM r WHERE role = 'train')
SELECT role, count(*) FILTER (WHERE y <= bound) AS rows_kept, count(*) FILTER (WHERE y > bound) AS rows_removed,
       round(max(bound), 4) AS scope_upper
FROM r, b GROUP BY role
""")
def scope_filter(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    _, _, report = scope(year_role(orders, "year", 2000), "o_totalprice")
    return report.withColumn("scope_upper", rounded("scope_upper"))
