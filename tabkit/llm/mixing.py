"""Mixing sources to target weights: weighted sampling without replacement by exponential keys.

Each source gets a target of words: the sources in code-point order (null last) take the given weights in
turn, share `share` times all words, and stop at `most` times their own words; what is over is shared out
again by weight. A source gives all its documents once per complete epoch of its target. The rest of the target
comes from the documents with the smallest keys -ln(u) / weight (Efraimidis and Spirakis), u a hash of the
document's id and text, summed until the target is reached.

No source is sorted: keys are cut into slices of about `slice_rows` rows, the sizes of slices are summed, and only
the slice in which a source's target ends is sorted, so that a source with a third of all rows is no hot
spot. Sources are numbered over ranges, and targets found by aggregates, so they may be many.

Weights from about 0.1 to 1 make even slices; any positive ones give right results.

Defined results: a null text has size 0 and is never taken; a null source is a source; weights that are null or not
positive count as 1e-9; rows with a null id or with one id have keys of their own if their texts differ; only rows
alike in id and text share a key, and any of them may be taken, with the same result; very long texts count like others;
a source without words has target 0; an empty table gives no rows; other columns are ignored, or carried along (`keep`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.common import WORD, uniform
from tabkit.session import written


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prose_weight(text: Column) -> Column:
    """A document's quality weight: 1 less five times the share of symbols that prose hardly has; 0.2 at least."""
    symbols = F.length(text) - F.length(F.translate(text, "#%*$|&!=<>{}", ""))
    return F.coalesce(F.greatest(F.lit(0.2), 1 - 5.0 * F.try_divide(symbols, F.length(text))), F.lit(0.2))


def numbered(table: DataFrame, by: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of column `by`, nulls last: ranges are sorted and counted apart."""
    ranged = table.repartitionByRange(F.col(by).asc_nulls_last()).sortWithinPartitions(F.col(by).asc_nulls_last())
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranges")
    sizes = ranged.groupBy(F.shiftright("at", 33).alias("range")).count().orderBy("range").collect()
    before, total = [], 0
    for r in sizes:
        before.append(F.when(F.col("range") == r["range"], F.lit(total)))
        total += r["count"]
    offset = F.coalesce(*before) if before else F.lit(0)
    found = ranged.withColumn("range", F.shiftright("at", 33))
    return found.withColumn(name, offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "range")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add each source's target to (source, source_size)."""
    rows = numbered(sizes, "source", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = written(rows.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size")), "sources")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    # level: words per unit of weight. It only rises, as sources reach their limits.
    level, full = 0.0, -1
    while True:
        is_full = F.col("limit") <= F.lit(level) * F.col("weight")
        sums = rows.agg(
            F.sum(F.when(is_full, F.col("limit"))).alias("held"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
            F.count(F.when(is_full, 1)).alias("full"),
        ).first()
        if not sums["open"] or sums["full"] == full:
            break
        full, level = sums["full"], max(level, (total - (sums["held"] or 0.0)) / sums["open"])
    if not sums["open"]:
        return rows.withColumn("target", F.col("limit")).select("source", "source_size", "target")
    return rows.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    most: float = 2.0,
    id_: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
    border: str = "cut",
    slice_rows: int = 50_000,
    rates: tuple[float, ...] = (0.2, 1.0),
    seed: int = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """id, size, source_size, target, taken, copies for every row, and the columns `keep`.

    `border`: a target usually ends inside a document. "cut" takes only its first words, as many as are missing;
    "whole" takes the document if at least half of it fits. copies counts the whole uses of the text, taken its words.
    The slices, one of which is sorted for each source, hold about two times `slice_rows` rows at most if weights lie
    between the `rates`; other weights give the same result with less even slices.
    """
    quality = F.greatest(F.lit(1e-9), F.coalesce(weight if weight is not None else prose_weight(F.col(text)), F.lit(0.0)))
    kept = [F.struct(*keep).alias("kept_")] if keep else []
    u = (uniform(seed, F.col(id_), F.md5(F.col(text).cast("binary"))) + 2.0**-50) / (1 + 2.0**-49)
    rows = docs.select(
        F.col(id_).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), quality.alias("w"), u.alias("u"), *kept
    )
    rows = rows.withColumn("key", -F.log(F.col("u")) / F.col("w")).drop("u")
    rows = rows.drop("w") if keep else written(rows.drop("w"), "mix")  # texts are not written, but read again
    slices = max(1, -(-docs.count() // slice_rows))
    # the share of keys below this one if each of `rates` were the weight of as many rows; it rises with the key
    above = sum((F.exp(-F.col("key") * r) for r in rates), F.lit(0.0)) / len(rates)
    rows = rows.withColumn("slice", F.floor((1 - above) * slices).cast("long"))

    by_slice = written(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    per_source = targets(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    per_source = written(
        per_source.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "mix-targets",
    )
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")
    ends = by_slice.withColumn("before", before).alias("l").join(per_source.alias("r"), same)
    ends = ends.where("before < budget AND before + words >= budget").select("r.source", F.col("slice").alias("end"), "before")
    known = per_source.alias("l").join(ends.alias("r"), same, "left").select("l.*", "end", "before")
    known = written(known, "mix-known")

    rows = rows.alias("l").join(known.alias("r"), same, "left")
    rows = rows.select("l.id", "l.source", "size", "key", "slice", "source_size", "target", "epochs", "budget", "end", "before", *["kept_"] * len(kept))
    inside = rows.where(F.col("slice") == F.col("end"))
    # the last comparison keeps it a running sum even for rows that are alike
    line = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("left", F.col("budget") - F.col("before") - F.sum("size").over(line) + F.col("size"))
    outside = rows.where(~F.coalesce(F.col("slice") == F.col("end"), F.lit(False)))
    outside = outside.withColumn("left", F.when(F.col("slice") < F.col("end"), F.col("size")).otherwise(F.lit(0)))
    rows = inside.unionByName(outside)
    if border == "cut":
        part = F.greatest(F.lit(0), F.least("size", "left"))
    else:
        part = F.when((F.col("left") > 0) & (2 * F.col("left") >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    rows = rows.withColumn("part", part.cast("long"))
    return rows.select(
        F.col("id").alias(id_),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        (F.col("epochs") + ((F.col("part") == F.col("size")) & (F.col("size") > 0)).cast("long")).alias("copies"),
        *["kept_.*"] * len(kept),
    )
