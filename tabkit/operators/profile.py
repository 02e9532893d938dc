"""Table and column profiles. Wide tables are aggregated to one row first and unpivoted afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.coerce import PLACEHOLDER
from tabkit.functions.numbers import skew
from tabkit.operators.quantiles import quantiles
from tabkit.session import attach, one_row, settle

# Words in column names that mark a family of columns. Families may overlap.
COLUMN_FAMILIES = {
    "building": ["year built", "property type", "gfa", "floor area", "number of buildings", "city", "borough"],
    "energy": ["energy", "eui", "electricity", "natural gas", "fuel oil", "steam"],
    "water": ["water"],
    "emissions": ["ghg", "emissions", "co2"],
    "id_meta": ["id", "name", "address", "postal", "bbl", "bin", "year ending", "calendar year"],
}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def per_column(
    df: DataFrame, columns: Sequence[str], measures: Mapping[str, object], name: str = "column_name"
) -> DataFrame:
    """One row per column from a single aggregate; `measures` maps a result name to column -> aggregate."""
    wide = df.agg(
        *[make(_q(c)).alias(f"{i}|{m}") for i, c in enumerate(columns) for m, make in measures.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias(name), *[_q(f"{i}|{m}").alias(m) for m in measures])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def type_histogram(df: DataFrame) -> DataFrame:
    """Columns and filled cells per data type, with the numeric / other split."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    filled = per_column(df, df.columns, {"filled": F.count})
    labels = F.create_map(*[F.lit(x) for c, k in kinds.items() for x in (c, k.simpleString())])
    numeric = F.col("column_name").isin([c for c, k in kinds.items() if is_numeric(k)])
    return (
        filled.withColumns({"data_type": labels[F.col("column_name")], "is_numeric": numeric.cast("int")})
        .groupBy("data_type", "is_numeric")
        .agg(F.count(F.lit(1)).alias("n_columns"), F.sum("filled").alias("filled_cells"))
    )


def column_families(df: DataFrame, families: Mapping[str, Sequence[str]] = COLUMN_FAMILIES) -> DataFrame:
    """Columns whose name contains a word of a family, and how many of their cells are filled."""
    filled = per_column(df, df.columns, {"filled": F.count})
    low = F.lower(F.col("column_name"))
    member = [
        F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(family))
        for family, words in families.items()
    ]
    return (
        filled.select("filled", F.explode(F.array_compact(F.array(*member))).alias("family"))
        .groupBy("family")
        .agg(F.count(F.lit(1)).alias("n_columns"), F.sum("filled").alias("filled_cells"))
    )


def placeholder_counts(df: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Occurrences of the placeholder per column, columns without any left out, most first."""
    counts = per_column(
        df, df.columns, {"n": lambda c: F.count_if(c.cast("string") == F.lit(placeholder))}
    )
    return counts.where("n > 0").orderBy(F.desc("n"), "column_name")


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    found = per_column(
        df,
        list(columns or df.columns),
        {
            "missing_count": lambda c: F.count_if(c.isNull()),
            "missing_rate": lambda c: F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))),
        },
    )
    return found.orderBy(F.desc("missing_rate"), "column_name")


def sparse_columns(df: DataFrame, limit: float, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose missing rate is above the limit, for `DataFrame.drop`."""
    return [r["column_name"] for r in missing_profile(df, columns).where(F.col("missing_rate") > limit).collect()]


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    label = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    found = per_column(
        df,
        columns,
        {
            "missing_count": lambda c: F.count_if(c.isNull()),
            "missing_rate": lambda c: F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))),
            "n_unique": F.count_distinct,
        },
    )
    return found.select(
        "column_name", label[F.col("column_name")].alias("data_type"), "missing_count", "missing_rate", "n_unique"
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in all columns; missing equals missing.

    Only a 64-bit hash per row is shuffled first. Whole rows are compared only where a hash repeats,
    and equal rows are merged before that shuffle too.
    """
    hashed = df.withColumn("__h", F.xxhash64(*[_q(c) for c in df.columns]))
    repeated = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    suspects = attach(hashed, repeated, ["__h"], "inner", max_rows=200_000, weight="__n").select(*[_q(c) for c in df.columns])
    same = suspects.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    extra = same.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    return extra


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum and missing cells of each column."""
    wide = per_column(
        df.select(*[_q(c).cast("double").alias(c) for c in columns]),
        columns,
        {
            "n": F.count,
            "mean": F.avg,
            "std": F.stddev,
            "min": F.min,
            "max": F.max,
            "missing_count": lambda c: F.count_if(c.isNull()),
            "missing_rate": lambda c: F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))),
        },
    )
    basic, _ = settle(wide)
    rows = sum(basic.select("n", "missing_count").first())
    wanted = {f"{i}|{p}": (f"`{c}`", p / 100) for i, c in enumerate(columns) for p in (25, 50, 75)}
    found = one_row(quantiles(df, wanted, known_rows=rows))
    lookup = F.create_map(
        *[
            x
            for i, c in enumerate(columns)
            for x in (F.lit(c), F.array(*[F.lit(found[f"{i}|{p}"]).cast("double") for p in (25, 50, 75)]))
        ]
    )
    marks = lookup[F.col("column_name")]
    return basic.select(
        "column_name", "n", "mean", "std", "min",
        marks[0].alias("p25"), marks[1].alias("p50"), marks[2].alias("p75"),
        "max", "missing_count", "missing_rate",
    )


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Size, missingness, sign, skew and upper tail of a target."""
    x = _q(target).cast("double")
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(x).alias("n"),
        F.try_divide(F.count_if(x.isNull()), F.count(F.lit(1))).alias("missing_rate"),
        F.count_if(x <= 0).alias("nonpositive_count"),
        skew(x).alias("skew"),
        F.max(x).alias("max"),
    )
    basic, _ = settle(wide)
    wanted = {"p99": (f"`{target}`", 0.99), "p999": (f"`{target}`", 0.999)}
    tail = one_row(quantiles(df, wanted, known_rows=basic.first()["rows"]))
    return basic.drop("rows").withColumns({k: F.lit(v).cast("double") for k, v in tail.items()})


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, missing left out, most first."""
    return (
        df.where(_q(column).isNotNull())
        .groupBy(_q(column).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category")
    )


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per category, missing kept."""
    counts = df.groupBy(_q(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    counts, _ = settle(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("proportion", F.try_divide(F.col("n"), F.lit(total)))


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    return category_counts(df, column).limit(k)


def rows_in_top(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows that belong to the k largest categories (k names, inlined)."""
    names = [r["category"] for r in top_categories(df, column, k).collect()]
    return df.where(_q(column).isin(names))


def correlation_matrix(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair, each over the rows where both are present."""
    labels = labels or {}
    xs = {c: _q(c).cast("double") for c in columns}
    pairs = [(c, c) for c in columns] + list(combinations(columns, 2))
    wide = df.agg(*[F.corr(xs[a], xs[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for one, two in {(a, b), (b, a)}:
            cells.append(
                F.struct(
                    F.lit(labels.get(one, one)).alias("a"),
                    F.lit(labels.get(two, two)).alias("b"),
                    F.col(f"c{i}").alias("r"),
                )
            )
    return wide.select(F.inline(F.array(*cells)))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where two columns are equal; a missing side counts as different."""
    same = F.count_if(F.coalesce(_q(a) == _q(b), F.lit(False)))
    total = F.count(F.lit(1))
    return df.agg(
        same.alias("same_count"),
        (total - same).alias("different_count"),
        F.try_divide(same, total).alias("same_rate"),
        F.try_divide(total - same, total).alias("different_rate"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed and empty bins are kept."""
    x = _q(column).cast("double")
    ends = one_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    place = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("int")
    counts = (
        df.where(x.isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (hi - lo) / bins
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left_edge"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right_edge"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last data points within 1.5 interquartile ranges, and outliers."""
    by = list(by)
    rows = df.select(*by, _q(column).cast("double").alias("x")).where("x is not null")
    for c in by:
        rows = rows.where(_q(c).isNotNull())
    marks = quantiles(rows, {"q1": ("x", 0.25), "median": ("x", 0.5), "q3": ("x", 0.75)}, by=by)
    if by:
        joined = attach(rows, marks, by)
    else:
        joined = rows.withColumns({k: F.lit(v).cast("double") for k, v in one_row(marks).items()})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
