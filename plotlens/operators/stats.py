"""Robust statistics over groups, exact. Groups of any size go through ``quantiles`` and ``spearman``; ``robust``
and what builds on it are for groups of bounded size, such as the comparables of one target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlens.session import drop_staged, staged

#: Steps of a value's natural logarithm that quantiles are first counted by: about 1.5 % each.
STEPS = 64
#: From the median absolute deviation to a standard deviation, and how many of them an outlier lies off.
MAD_TO_SIGMA, OUTLIER_SIGMAS = 1.4826, 3.0


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], name: str = "q") -> DataFrame:
    """``(*keys, n, name)``: the exact quantiles of each group, linear between ranks, as an array in the order of ``qs``.

    No group is held or sorted whole. A first pass counts values by fine steps of their logarithm,
    combined in the map tasks; the counts name the steps that hold the wanted ranks. A second pass
    counts the values of those steps only, and finds the ranks by running sums within a step.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null").withColumn("__s", step_of("__v"))
    hist = staged(rows.groupBy(*keys, "__s").agg(F.count("*").alias("c")), "histogram")
    wanted = staged(wanted_ranks(hist, keys, qs), "wanted-ranks")
    out = staged(values_at(rows.withColumn("__c", F.lit(1)), wanted, keys, qs, name), "quantiles")
    drop_staged(hist, wanted)
    return out


def step_of(value: str) -> Column:
    """The step of a double: rising with it, about 1.5 % wide, zero for zero."""
    size = F.floor(F.log(F.abs(value)) * STEPS).cast("bigint") + (1 << 40)
    return F.when(F.col(value) > 0, size).when(F.col(value) < 0, -size).otherwise(F.lit(0).cast("bigint"))


def wanted_ranks(hist: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """``(*keys, __s, n, lo, ranks)`` of the steps that hold ranks which the quantiles need, by counts ``c`` of each step ``__s``."""
    upto = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hist.withColumn("hi", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array_distinct(F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)]))
    inside = F.filter(ranks, lambda r: (r >= F.col("hi") - F.col("c")) & (r < F.col("hi")))
    return placed.select(*keys, "__s", "n", (F.col("hi") - F.col("c")).alias("lo"), inside.alias("ranks")).where(F.size("ranks") > 0)


def values_at(rows: DataFrame, wanted: DataFrame, keys: list[str], qs: list[float], name: str) -> DataFrame:
    """``(*keys, n, name)``: the quantiles of ``rows`` ``(*keys, __s, __v, __c)``, of which only those in the wanted steps are looked at."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}"))
    met = rows.alias("r").join(wanted.alias("w"), same & (F.col("r.__s") == F.col("w.__s"))).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r.__s", "r.__v", "r.__c", "n", "lo", "ranks")
    values = met.groupBy(*keys, "__s", "n", "lo", "ranks", "__v").agg(F.sum("__c").alias("c"))
    within = Window.partitionBy(*keys, "__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("hi", F.col("lo") + F.sum("c").over(within))
    hit = values.select(*keys, "n", "__v", F.explode(F.filter("ranks", lambda r: (r >= F.col("hi") - F.col("c")) & (r < F.col("hi")))).alias("rank"))
    found = hit.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "__v"))).alias("__at"))
    value_at = lambda r: F.element_at("__at", r.cast("bigint"))

    def between(a: Column) -> Column:
        low, high, part = value_at(F.floor(a)), value_at(F.ceil(a)), a - F.floor(a)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return found.select(*keys, "n", F.array(*[between((F.col("n") - 1) * F.lit(float(q))) for q in qs]).alias(name))


def robust(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(*keys, n, median, sigma)``: two exact passes, the second over distances from the joined median."""
    df = df.where(F.col(value).isNotNull()).select(*keys, value)
    first = df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(value).alias("median"))
    far = df.join(first, keys).withColumn("off", F.abs(F.col(value) - F.col("median")))
    return far.groupBy(*keys, "n", "median").agg((F.median("off") * MAD_TO_SIGMA).alias("sigma"))


def drop_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows within three sigmas of their group's median; groups under five rows or without spread stay whole."""
    of = robust(df, keys, value).withColumnsRenamed({"n": "__n", "median": "__median", "sigma": "__sigma"})
    near = F.abs(F.col(value) - F.col("__median")) <= OUTLIER_SIGMAS * F.col("__sigma")
    kept = df.join(of, keys).where((F.col("__n") < 5) | (F.col("__sigma") <= 0) | near)
    return kept.drop("__n", "__median", "__sigma")


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """``(*keys, name)``: a value's place is the weight below it plus half its own; between places it is linear.

    Beyond the outer places the outer values hold. Ties of the value are taken in the order of the weight.
    """
    order = Window.partitionBy(*keys).orderBy(value, weight)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    run = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = df.withColumn("__at", (run - F.col(weight) / 2) / total)
    placed = placed.withColumn("__next_at", F.lead("__at").over(order)).withColumn("__next", F.lead(value).over(order))
    v, at, nxt, nxt_at = F.col(value), F.col("__at"), F.col("__next"), F.col("__next_at")
    span = nxt_at - at
    inside = F.when((at <= q) & (nxt_at > q), F.when(span > 0, v + (nxt - v) * (q - at) / span).otherwise(v))
    low = F.min_by(v, F.struct(at, v))
    return placed.groupBy(*keys).agg(F.coalesce(F.when(F.min("__at") > q, low), F.max(inside), F.max_by(v, F.struct(at, v))).alias(name))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's correlation; null where a side is constant, which ``corr`` divides by in ANSI mode."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """The rank correlation of each group; NaN where a side is constant. Rows without one of the values don't count."""
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("__n"))
    return spearman_of_counts(counts, keys, x, y, "__n", name)


def spearman_of_counts(counts: DataFrame, keys: list[str], x: str, y: str, count: str, name: str = "rho") -> DataFrame:
    """``spearman`` from how often each pair of values occurs.

    Ranks come from running sums over the distinct values of a side, and are taken from their mean, which is known.
    """
    for c in (x, y):
        held = counts.groupBy(*keys, c).agg(F.sum(count).alias("__c"))
        upto = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranks = held.withColumn("__hi", F.sum("__c").over(upto)).withColumn("__all", F.sum("__c").over(Window.partitionBy(*keys)))
        rank = F.col("__hi") - (F.col("__c") - 1) / 2 - (F.col("__all") + 1) / 2
        counts = counts.join(ranks.select(*keys, c, rank.alias(f"__off_{c}")), [*keys, c])
    a, b, n = F.col(f"__off_{x}"), F.col(f"__off_{y}"), F.col(count)
    rho = F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b)))
    return counts.groupBy(*keys).agg(F.coalesce(rho, F.lit(float("nan"))).alias(name))


def slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of ``y`` on ``x`` by group: ``(*keys, n, slope, intercept, r2)``."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def theil_sen(df: DataFrame, keys: list[str], x: str, log_y: str) -> DataFrame:
    """``(*keys, slope)``: the median slope of all pairs of a series. Series are short: a point for each quarter."""
    a, b = df.select(*keys, F.col(x).alias("x1"), F.col(log_y).alias("y1")), df.select(*keys, F.col(x).alias("x2"), F.col(log_y).alias("y2"))
    pairs = a.join(b, keys).where("x1 < x2").withColumn("slope", (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    return pairs.groupBy(*keys).agg(F.median("slope").alias("slope"))


def histogram(df: DataFrame, value: str, width: float = 10.0, bins: int = 10) -> DataFrame:
    """``(bin, n)`` for all bins of a scale from 0; the last one is closed, and empty ones count zero."""
    at = F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
