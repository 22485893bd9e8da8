"""Exact quantiles of groups that are kept up to date: a batch costs its own rows and what it touches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.operators import stats
from plotlens.session import drop_staged, staged
from plotlens.sources.keyed_table import BUCKETS, KeyedTable


class StoredQuantiles:
    """Three keyed tables under one path: counts by step, counts by value, and the quantiles of each group.

    A batch adds its counts to the first two; then the steps of its groups say where their ranks are now, and of the
    values only the buckets that hold these steps are read. ``remove`` takes rows back that were added before. A batch that
    stopped between the tables is completed by running it again: each table knows the runs it has. Rows with a null in the
    key, or without a value, are left out; a group whose rows were all removed is not listed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], qs: list[float], buckets: int = BUCKETS):
        self.keys, self.qs = keys, qs
        self.steps = KeyedTable(spark, f"{path}/steps", [*keys, "__s"], buckets, by=keys)
        self.values = KeyedTable(spark, f"{path}/values", [*keys, "__s", "__v"], buckets, by=[*keys, "__s"])
        self.found = KeyedTable(spark, f"{path}/quantiles", keys, buckets)

    def add(self, rows: DataFrame, value: str, run: tuple[str, int] | None = None) -> None:
        self._update(rows, value, 1, run)

    def remove(self, rows: DataFrame, value: str, run: tuple[str, int] | None = None) -> None:
        self._update(rows, value, -1, run)

    def read(self) -> DataFrame:
        """``(*keys, n, q)`` of all groups."""
        return self.found.read().where("n > 0")

    def _update(self, rows: DataFrame, value: str, sign: int, run: tuple[str, int] | None) -> None:
        counted = rows.select(*self.keys, F.col(value).cast("double").alias("__v")).where("__v is not null").dropna(subset=self.keys)
        counted = counted.groupBy(*self.keys, "__v").agg((F.count("*") * sign).alias("c")).withColumn("__s", stats.step_of("__v"))
        counted = staged(counted, "counted-values", keep=True)
        self.values.upsert(counted, sums=["c"], run=run)
        self.steps.upsert(counted.groupBy(*self.keys, "__s").agg(F.sum("c").alias("c")), sums=["c"], run=run)
        groups = staged(counted.select(*self.keys).distinct(), "touched-groups", keep=True)
        hist = self.steps.read(buckets=_buckets(groups, self.steps)).where("c > 0").join(groups, self.keys, "left_semi")
        wanted = staged(stats.wanted_ranks(hist, self.keys, self.qs), "wanted-ranks", keep=True)
        held = self.values.read(buckets=_buckets(wanted, self.values)).where("c > 0").withColumnRenamed("c", "__c")
        now = stats.values_at(held, wanted, self.keys, self.qs, "q")
        now = groups.join(now, self.keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))  # null quantiles: nothing is left
        self.found.upsert(now, run=run)
        drop_staged(counted, groups, wanted)


def _buckets(rows: DataFrame, table: KeyedTable) -> Iterable[int]:
    return [r[0] for r in rows.select(table.bucket().alias("bucket")).distinct().collect()]
