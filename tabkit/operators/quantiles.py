"""Exact quantiles by linear interpolation, at any number of rows.

Few rows: one `percentile` aggregate, whose buffer is a value -> count map for each group.

Many rows: that map would not fit, so ranks are selected by narrowing. A mergeable sketch brackets
every wanted rank of all columns; one more aggregate counts the rows below the bracket and the rows at each value
inside it. Only values inside a bracket are shuffled, and equal values are counted before the shuffle,
so a value or group that holds a third of the rows costs no more than another. The results are the same: a column or group without
any value gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.session import as_col, attach, settle

SMALL_ROWS = 2_000_000
GRID = 1000
ACCURACY = 10_000
FINISH_VALUES = 4_000_000


def is_small(df: DataFrame, limit: int | None = None, known_rows: int | None = None) -> bool:
    """`known_rows` saves the count where the caller already has it, or a bound on it."""
    rows = df.count() if known_rows is None else known_rows
    return rows <= (SMALL_ROWS if limit is None else limit)


def quantiles(
    df: DataFrame,
    wanted: Mapping[str, tuple[str | Column, float]],
    by: Sequence[str] = (),
    small_rows: int | None = None,
    known_rows: int | None = None,
) -> DataFrame:
    """One row per group (one in all without `by`), one column per wanted (column, fraction).

    Rows with a missing group are left out.
    """
    by = list(by)
    for c in by:
        df = df.where(F.col(c).isNotNull())
    sources: dict[str, Column] = {}
    for column, _ in wanted.values():
        sources.setdefault(str(column), as_col(column).cast("double"))
    if is_small(df, small_rows, known_rows):
        return _direct(df, wanted, sources, by)
    return _selected(df, wanted, sources, by)


def _direct(df, wanted, sources, by):
    fractions = {name: [] for name in sources}
    for column, q in wanted.values():
        if q not in fractions[str(column)]:
            fractions[str(column)].append(q)
    slots = {name: f"__q{i}" for i, name in enumerate(sources)}
    grouped = df.groupBy(*by).agg(
        *[
            F.percentile(sources[name], F.array(*[F.lit(float(q)) for q in fractions[name]])).alias(slot)
            for name, slot in slots.items()
        ]
    )
    return grouped.select(
        *by,
        *[
            F.col(slots[str(c)])[fractions[str(c)].index(q)].alias(alias)
            for alias, (c, q) in wanted.items()
        ],
    )


def _selected(df, wanted, sources, by):
    fractions = {alias: Fraction(str(q)) for alias, (_, q) in wanted.items()}

    def ranks(name: str, n: Column) -> list[tuple[str, Column]]:
        found = []
        for alias, q in fractions.items():
            if str(wanted[alias][0]) == name:
                step = F.lit(q.numerator) * (n - 1)
                low = F.floor(step / q.denominator) if q.denominator > 1 else step
                whole = step % q.denominator == 0
                found += [(f"{alias}|0", low), (f"{alias}|1", F.when(whole, low).otherwise(low + 1))]
        return found

    picked = values_at_ranks(df, sources, by, ranks)
    columns = []
    for alias, q in fractions.items():
        mine = F.col("t").startswith(f"{alias}|")
        low = F.max(F.when(F.col("t") == f"{alias}|0", F.col("v")))
        high = F.max(F.when(F.col("t") == f"{alias}|1", F.col("v")))
        n = F.max(F.when(mine, F.col("n")))
        part = ((F.lit(q.numerator) * (n - 1)) % q.denominator) / F.lit(float(q.denominator))
        # equal neighbours, infinite ones too, need no arithmetic
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(alias))
    return picked.groupBy(*by).agg(*columns)


def values_at_ranks(
    df: DataFrame,
    sources: Mapping[str, Column],
    by: list[str],
    ranks: Callable[[str, Column], list[tuple[str, Column]]],
    place: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The value at each wanted 0-based rank of each group and source; sources are columns of one type.

    `ranks` maps a source's name and its number of values in the group to (tag, rank) pairs, no tag twice; a
    NULL rank is skipped. `place` maps a value to a double that never falls as the value grows (default: a
    cast). Brackets are made of these doubles, the values themselves stay exact. Result: the group, `t`, `n`,
    `r`, `v` and `below`, the number of the group's values that are smaller than `v`; a group (of `by`)
    without any value has one row for each tag, with n = 0 and no `v`.
    """
    place = place or (lambda x: x.cast("double"))
    steps = [i / GRID for i in range(GRID + 1)]
    rows = df.select(*by, F.array(*sources.values()).alias("xs"))
    # without groups the sketches of all tasks meet in one: a task per core makes them
    dealt = rows if by else rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    sketch = dealt.groupBy(*by).agg(
        *[F.count(F.col("xs")[i]).alias(f"__n{i}") for i in range(len(sources))],
        *[F.percentile_approx(place(F.col("xs")[i]), steps, ACCURACY).alias(f"__g{i}") for i in range(len(sources))],
    )
    pairs = [
        F.struct(
            F.lit(tag).alias("t"), F.lit(i).alias("s"), F.col(f"__n{i}").alias("n"), rank.cast("long").alias("r"),
            F.col(f"__g{i}").alias("__g"),
        )
        for i, name in enumerate(sources)
        for tag, rank in ranks(name, F.col(f"__n{i}"))
    ]
    state = sketch.select(*by, F.inline(F.array(*pairs))).where("r is not null")
    state, largest = _settled(state.select(*by, "t", "s", "n", "r", *_bracket(F.col("r"), F.col("n"))), by, "n")
    asked, widest = state, largest * 8 // GRID
    while widest > FINISH_VALUES:
        state, now = _settled(_tightened(_near(rows, state, by, place), by, steps, place), by, "kinds")
        if now >= widest:
            break
        widest = now
    counts = (
        _near(rows, state, by, place)
        .groupBy(*by, "t", "n", "r", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    upto = Window.partitionBy(*by, "t").orderBy(F.col("v").asc_nulls_first())
    placed = counts.withColumn(
        "upto", F.sum("c").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).where("v is not null and upto > r")
    hit = F.min(F.struct("v", (F.col("upto") - F.col("c")).alias("below"))).alias("hit")
    if not by:
        return placed.groupBy("t", "n", "r").agg(hit).select("t", "n", "r", "hit.v", "hit.below")
    hits = placed.groupBy(*by, "t").agg(hit)
    return asked.select(*by, "t", "n", "r").join(hits, [*by, "t"], "left").select(*by, "t", "n", "r", "hit.v", "hit.below")


def _settled(state: DataFrame, by: list[str], measure: str) -> tuple[DataFrame | list, int]:
    """The state, computed once, and its largest `measure`. Without groups it is a list of a row for each tag."""
    if not by:
        state = state.collect()
        return state, max((r[measure] or 0 for r in state), default=0)
    state, _ = settle(state)
    return state, state.agg(F.max(measure)).first()[0] or 0


def _bracket(rank: Column, size: Column) -> tuple[Column, Column]:
    """Two grid steps of slack on each side; the sketch errs by a tenth of a step."""
    size = F.nullif(size, F.lit(0))
    first = F.greatest(F.lit(1), F.floor(rank * GRID / size).cast("int") - 1)
    last = F.least(F.lit(GRID + 1), F.ceil((rank + 1) * GRID / size).cast("int") + 3)
    return F.element_at("__g", first).alias("lo"), F.element_at("__g", last).alias("hi")


def _near(rows: DataFrame, state: DataFrame | list, by: list[str], place: Callable[[Column], Column]) -> DataFrame:
    """Each row once per rank it may decide: `v` is its value inside the bracket, NULL below it."""
    if by:
        spans = state.where("n > 0").groupBy(*by).agg(
            F.collect_list(F.struct("t", "s", "n", "r", "lo", "hi")).alias("__b"), F.max("n").alias("__n")
        )
        tagged = attach(rows, spans, by, "inner", weight="__n")
    else:
        parts = [F.struct(*[F.lit(r[c]) for c in ("t", "s", "n", "r", "lo", "hi")]) for r in state if r["n"]]
        kind = "array<struct<t:string,s:int,n:bigint,r:bigint,lo:double,hi:double>>"
        tagged = rows.withColumn("__b", F.array(*parts).cast(kind))
    found = tagged.select(*by, "xs", F.inline("__b")).withColumn("x", F.expr("xs[s]"))
    found = found.withColumn("p", place(F.col("x"))).where("p <= hi")
    return found.select(*by, "t", "s", "n", "r", F.when(F.col("p") >= F.col("lo"), F.col("x")).alias("v"))


def _tightened(near: DataFrame, by: list[str], steps: list[float], place: Callable[[Column], Column]) -> DataFrame:
    inside = near.groupBy(*by, "t", "s", "n", "r").agg(
        F.count_if(F.col("v").isNull()).alias("under"),
        F.count("v").alias("m"),
        F.approx_count_distinct("v").alias("kinds"),
        F.percentile_approx(place(F.col("v")), steps, ACCURACY).alias("__g"),
    )
    return inside.select(
        *by, "t", "s", "n", "r", "kinds", *_bracket(F.col("r") - F.col("under"), F.col("m"))
    )
