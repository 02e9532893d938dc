"""k-means with repeated starts, and the measures to choose and describe a clustering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.operators import lloyd
from tabkit.operators.clean import sample_rows
from tabkit.operators.quantiles import quantiles
from tabkit.session import written

# Names of a three-cluster solution.
HIGH_FIRST = "High Energy - Moderate Water"
HIGH_SECOND = "Moderate Energy - Higher Water"
LOW_BOTH = "Low Energy - Low Water"

SEEDS = (7, 11, 21, 42, 88)


def vectors(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def best_kmeans(df: DataFrame, k: int, seed: int = 42, starts: int = 20, features: str = "features") -> lloyd.CentresModel:
    """The start with the least inertia, the first of equal ones; all starts move in the same scans."""
    table = lloyd.points(df, vector_to_array(F.col(features)))
    sets, costs = lloyd.many_kmeans(table, dict.fromkeys(range(starts), k), seed)
    best = lloyd.best_starts(dict.fromkeys(range(starts), 0), costs)[0]
    return lloyd.CentresModel.of(sets[best], costs[best], features)


def inertia(df: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """Summed squared distance of the rows to the mean of their own cluster.

    Needs one aggregate: the squared distances of a cluster sum to n times its population variances.
    """
    parts = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    total = F.col("v0")
    for i in range(1, len(columns)):
        total = total + F.col(f"v{i}")
    return parts.agg(F.sum(F.col("n") * total).alias("inertia"), F.count(F.lit(1)).alias("n_clusters"))


def silhouette(
    df: DataFrame, features: str, label: str, key: str, sample_size: int | None = 2000, seed: int = 42, order: Column | None = None, block: int = 1000
) -> DataFrame:
    """Mean Euclidean silhouette of a sample of at most `sample_size` rows (None: all rows).

    `order`, an expression of the key under the name k, gives the sample (default: a seeded hash). For all rows of a
    large table `squared_silhouette` needs no distances between rows.

    The sample is dealt into blocks of about `block` rows that meet pairwise: a task adds up the distances of one
    block's rows to another's, per cluster, so what is shuffled is sample x blocks rows and no pairs. `features` is an array column.
    """
    chosen = df.select(F.col(key).alias("k"), F.col(features).cast("array<double>").alias("x"), F.col(label).alias("c"))
    if sample_size is not None:
        chosen = sample_rows(chosen, sample_size, "k", seed, order)
    rows = written(chosen.select("x", "c").withColumn("no", F.monotonically_increasing_id()), "silhouette-rows")
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if found[0] < 2:
        raise ValueError("the sample has fewer than two clusters")
    blocks = -(-found[1] // block)
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("no"), F.lit(blocks))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    mine = dealt.select((F.col("b") * blocks + F.col("o")).alias("g"), F.lit(True).alias("asks"), "no", "c", "x")
    others = dealt.select((F.col("o") * blocks + F.col("b")).alias("g"), F.lit(False).alias("asks"), "no", "c", "x")
    kind = df.schema[label].dataType.simpleString()

    def add(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        x = np.array(table.column("x").to_pylist(), dtype=float)
        here, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        names = table.column("c").take(pa.array(there)).combine_chunks().dictionary_encode()
        if len(here) and len(there):
            member = np.eye(len(names.dictionary))[names.indices.to_numpy()]
            # Differences, not the expanded square: a row's distance to itself must be exactly 0.
            gaps = (np.sqrt(((x[here[i : i + 16], None] - x[there]) ** 2).sum(2)) for i in range(0, len(here), 16))
            sums = np.concatenate([g @ member for g in gaps])
        else:
            sums = np.empty((0, len(names.dictionary)))
        each = np.repeat(np.arange(len(sums)), sums.shape[1])
        columns = {
            "no": table.column("no").take(pa.array(here[each])),
            "c": table.column("c").take(pa.array(here[each])),
            "other": names.dictionary.take(pa.array(np.tile(np.arange(sums.shape[1]), len(sums)))),
            "s": pa.array(sums.ravel()),
        }
        return pa.table(columns)

    sums = mine.unionByName(others).groupBy("g").applyInArrow(add, f"no long, c {kind}, other {kind}, s double")
    sums = sums.groupBy("no", "c", "other").agg(F.sum("s").alias("s")).join(sizes.withColumnRenamed("c", "other"), "other")
    own = F.col("c") == F.col("other")
    rated = sums.groupBy("no").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("inside"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("outside"),
    )
    larger = F.greatest("inside", "outside")
    value = F.when((F.col("size") > 1) & (larger > 0), (F.col("outside") - F.col("inside")) / larger).otherwise(0.0)
    return rated.agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n_sampled"))


def squared_silhouette(df: DataFrame, features: str = "features", label: str = "cluster") -> DataFrame:
    """Silhouette with squared distances over all rows, from sums per cluster instead of row pairs."""
    measure = ClusteringEvaluator(featuresCol=features, predictionCol=label, metricName="silhouette")
    return df.sparkSession.createDataFrame([(measure.evaluate(df),)], "silhouette double")


def adjusted_rand(df: DataFrame, labelings: Mapping[str, str]) -> DataFrame:
    """Adjusted Rand index of every pair of labelings (name -> column) that share a row.

    All pairs come from one count of label tuples; 1 when both labelings are trivial.
    """
    names = list(labelings)
    # rows are shuffled once, as counts of their label tuples; pairs of labelings are formed from those
    cube = df.groupBy(*[F.col(labelings[n]).alias(f"l{i}") for i, n in enumerate(names)]).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(
        *[
            F.struct(F.lit(names[i]).alias("first"), F.lit(names[j]).alias("second"), F.col(f"l{i}").alias("a"), F.col(f"l{j}").alias("b"), "n")
            for i, j in combinations(range(len(names)), 2)
        ]
    )
    counts = written(cube.select(F.inline(cells)).groupBy("first", "second", "a", "b").agg(F.sum("n").alias("n")), "contingency")

    def pairs(n: Column) -> Column:
        n = n.cast("double")
        return n * (n - 1) / 2

    def margin(column: str, out: str) -> DataFrame:
        sums = counts.groupBy("first", "second", column).agg(F.sum("n").alias("m"))
        return sums.groupBy("first", "second").agg(F.sum(pairs(F.col("m"))).alias(out))

    both = counts.groupBy("first", "second").agg(
        F.sum(pairs(F.col("n"))).alias("together"), F.sum("n").alias("rows")
    )
    joined = both.join(margin("a", "in_a"), ["first", "second"]).join(margin("b", "in_b"), ["first", "second"])
    chance = F.try_divide(F.col("in_a") * F.col("in_b"), pairs(F.col("rows")))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return joined.select(
        "first",
        "second",
        F.coalesce(F.try_divide(F.col("together") - chance, most - chance), F.lit(1.0)).alias("ari"),
    )


def k_sweep(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    ks: Sequence[int] = range(2, 11),
    seeds: Sequence[int] = SEEDS,
    starts: int = 20,
    tolerance: float = 1e-4,
) -> DataFrame:
    """Mean inertia, silhouette (of squared distances, over all rows) and pairwise stability for each number of clusters."""
    spark = df.sparkSession
    table = lloyd.points(df, F.array(*[F.col(f"`{c}`") for c in columns]), key)
    names = lloyd.named_sets(ks, seeds, starts)
    sets, costs = lloyd.many_kmeans(table, {n: k for n, (k, _) in names.items()}, len(names), tolerance=tolerance)
    best = lloyd.best_starts(names, costs)
    chosen = {n: sets[n] for n in best.values()}
    order = {n: i for i, n in enumerate(sorted(chosen))}
    widths = lloyd.squared_silhouettes(table, chosen)
    labelled = written(lloyd.with_labels(table, chosen, key), "labels")
    rows = []
    for k in ks:
        mine = {str(s): best[k, s] for s in seeds}
        frame = labelled.select(*[F.col("labels")[order[n]].alias(f"c{s}") for s, n in mine.items()])
        stable = adjusted_rand(frame, {s: f"c{s}" for s in mine}).agg(F.avg("ari")).first()[0] if len(mine) > 1 else 1.0
        costs_k, widths_k = [costs[n] for n in mine.values()], [widths[n] for n in mine.values()]
        rows.append((k, float(np.mean(costs_k)), float(np.mean(widths_k)), float(stable)))
    return spark.createDataFrame(
        rows, "k int, inertia_mean double, silhouette_mean double, stability_mean_ari double"
    )


def cluster_profile(
    df: DataFrame, label: str, means: Mapping[str, str], medians: Mapping[str, str], centres: DataFrame | None = None
) -> DataFrame:
    """Size, means and medians per cluster (result name -> column), joined with its centre."""
    sizes = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(name) for name, c in means.items()]
    )
    middle = quantiles(df, {name: (c, 0.5) for name, c in medians.items()}, by=[label])
    out = sizes.join(middle, label, "left")
    return out if centres is None else out.join(centres, label, "left")


def name_clusters(centres: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """Names from the order of the centres, not from arbitrary ids (one row per cluster).

    Highest on `first`; of the others highest on `second`; lowest of three on both. Beyond three
    clusters the rest are named by their rank.
    """
    ranked = centres.withColumn("__first", F.row_number().over(Window.orderBy(F.desc(first), label)))
    rest = Window.partitionBy((F.col("__first") == 1).cast("int")).orderBy(F.desc(second), label)
    ranked = ranked.withColumn("__second", F.row_number().over(rest))
    name = (
        F.when(F.col("__first") == 1, F.lit(HIGH_FIRST))
        .when(F.col("__second") == 1, F.lit(HIGH_SECOND))
        .when(F.col("__second") == 2, F.lit(LOW_BOTH))
        .otherwise(F.concat(F.lit("Cluster rank "), (F.col("__second") + 1).cast("string")))
    )
    return ranked.withColumn("cluster_name", name).drop("__first", "__second")


def nearest_centre(
    df: DataFrame, columns: Sequence[str], centres: Sequence[tuple[int, Sequence[float]]], out: str = "cluster"
) -> DataFrame:
    """Id of the closest centre by squared distance, ties to the smaller id; k comparisons per row."""
    options = []
    for name, centre in centres:
        gap = F.lit(0.0)
        for c, at in zip(columns, centre):
            gap = gap + (F.col(c) - F.lit(float(at))) * (F.col(c) - F.lit(float(at)))
        options.append(F.struct(gap.alias("d"), F.lit(name).alias("c")))
    best = F.least(*options) if len(options) > 1 else options[0]
    usable = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        usable = usable & F.col(c).isNotNull()
    return df.withColumn(out, F.when(usable, best["c"]))


