"""Observations of offers: changes against the state, price log, expiry, silence; and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_log(observations: DataFrame, keys: list[str], at: str, value: str, order: str) -> DataFrame:
    """Each observation with ``change``: ``new``, ``changed`` or ``unchanged`` against the one before of its key."""
    before = Window.partitionBy(*keys).orderBy(at, order)
    previous = F.lag(value).over(before)
    first = F.row_number().over(before) == 1
    same = previous.eqNullSafe(F.col(value))
    return observations.withColumn("change", F.when(first, "new").when(same, "unchanged").otherwise("changed")).withColumn("previous", previous)


def price_log(observations: DataFrame, keys: list[str], at: str, value: str, order: str) -> DataFrame:
    """The observations that a price history keeps: the first known price, and each other known one after it."""
    rows = observations.where(F.col(value).isNotNull())
    before = Window.partitionBy(*keys).orderBy(at, order)
    previous = F.lag(value).over(before)
    return rows.withColumn("previous", previous).where(F.col("previous").isNull() | (F.col("previous") != F.col(value)))


def activity(observations: DataFrame, keys: list[str], at: str, as_of: Column, days: int = 14) -> DataFrame:
    """``(*keys, first_seen, last_seen, n, active)``: inactive once unseen for ``days``."""
    out = observations.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))
    return out.withColumn("active", F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(days)))


def rolling_counts(observations: DataFrame, source: str, at: str, as_of: Column, known: DataFrame | None = None) -> DataFrame:
    """Rows of each source in the last day, week and fortnight; sources of ``known`` without rows count zero."""
    recent = lambda d: F.count_if(F.col(at) > as_of - F.make_dt_interval(F.lit(d)))
    out = observations.groupBy(source).agg(recent(1).alias("day"), recent(7).alias("week"), recent(14).alias("fortnight"), F.max(at).alias("last"))
    if known is None:
        return out
    return known.join(out, source, "left").fillna(0, ["day", "week", "fortnight"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str | None = None, keep_known: bool = False) -> DataFrame:
    """``old`` merged with ``new`` by key: the new row wins or, with ``keep_known``, each of its known values.

    Of new rows with one key the latest by ``at`` counts.
    """
    rest = [c for c in old.columns if c not in keys]
    if at:
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*")
    a = old.select(*keys, F.struct(*rest).alias("__a"))
    b = new.select(*keys, F.struct(*rest).alias("__b"))
    both = a.join(b, keys, "full_outer")
    pick = (lambda c: F.coalesce(F.col(f"__b.{c}"), F.col(f"__a.{c}"))) if keep_known else (lambda c: F.when(F.col("__b").isNotNull(), F.col(f"__b.{c}")).otherwise(F.col(f"__a.{c}")))
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is complete, unseen and not repeated: what an idempotent load appends."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    return new.where(complete).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def rebuilt(old: DataFrame, new: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """A rebuilt table: the new rows with the verdicts of the old, and old rows that have a verdict."""
    rest = [c for c in new.columns if c not in keys and c != verdict]
    held = old.where(F.col(verdict).isNotNull())
    both = new.select(*keys, F.struct(*rest).alias("__b")).join(held.select(*keys, F.struct(*rest).alias("__a"), verdict), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(F.col("__b"), F.col("__a"))[c].alias(c) for c in rest], verdict)
