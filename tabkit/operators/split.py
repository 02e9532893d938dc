"""Train / test roles. A row keeps its role whatever the partitioning; no frame is copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators.clean import at_most, upper_bound
from tabkit.session import settle

TRAIN, TEST = "train", "test"


def hash_slot(key: str | Column, slots: int, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(slots))


def random_role(
    df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, slot: Column | None = None, out: str = "role"
) -> DataFrame:
    """Random holdout by a seeded hash of the row key. `slot` may give another number in 0..9999."""
    slot = hash_slot(key, 10_000, seed) if slot is None else slot
    return df.withColumn(out, F.when(slot < round(test_share * 10_000), TEST).otherwise(TRAIN))


def year_role(df: DataFrame, year: str, holdout: int | None = None, out: str = "role") -> DataFrame:
    """Earlier years train, the holdout year (by default the last one) tests, later years have no role."""
    years = F.col(year).cast("int")
    held = F.lit(0) if holdout is None else F.count_if(years == holdout)
    found = df.agg(F.max(years).alias("last"), F.min(years).alias("first"), held.alias("held")).first()
    if found["last"] is None:
        raise ValueError(f"no valid years in {year}")
    test_rows = found["held"] if holdout is not None else 1
    holdout = found["last"] if holdout is None else holdout
    if found["first"] >= holdout or not test_rows:
        raise ValueError(f"empty split at {holdout}: years {found['first']} to {found['last']}")
    ranked = df.withColumn(out, F.when(years < holdout, TRAIN).when(years == holdout, TEST))
    return ranked.where(F.col(out).isNotNull())


def entity_role(
    df: DataFrame,
    entity: str,
    key: str,
    test_share: float = 0.2,
    seed: int = 42,
    slot: Column | None = None,
    out: str = "role",
) -> DataFrame:
    """Holdout of whole entities. A row without an entity is an entity of its own."""
    text = F.coalesce(F.col(entity).cast("string"), F.concat(F.lit("row|"), F.col(key).cast("string")))
    slot = hash_slot(text, 10_000, seed) if slot is None else slot
    return df.withColumn(out, F.when(slot < round(test_share * 10_000), TEST).otherwise(TRAIN))


def scope(
    df: DataFrame, target: str, q: float = 0.99, role: str = "role"
) -> tuple[DataFrame, float, DataFrame]:
    """Drop rows above the q-quantile of the train target from both roles.

    Returns the kept rows, the bound, and per role the rows kept and removed. Both roles must keep rows.
    """
    bound = upper_bound(df.where(F.col(role) == TRAIN), target, q)
    if bound is None:
        raise ValueError("empty split: no train rows")
    keep = at_most(df, target, bound)
    report, _ = settle(
        df.groupBy(role).agg(
            F.count_if(keep).alias("rows_kept"),
            (F.count(F.lit(1)) - F.count_if(keep)).alias("rows_removed"),
            F.lit(bound).alias("scope_upper"),
        )
    )
    kept = {r[role]: r["rows_kept"] for r in report.collect()}
    if not kept.get(TRAIN) or not kept.get(TEST):
        raise ValueError(f"empty split: rows per role {kept}")
    return df.where(keep), bound, report
