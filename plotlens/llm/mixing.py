"""Mixing sources to target weights by Poisson replication. DataFrame operations only.

A source with a share ``n_s / n`` of the rows and a target weight ``w_s`` repeats each of its rows
``epochs * n * w_s / n_s`` times in the mean. A row's count comes from a uniform number hashed from
its id and the seed, by inverting the Poisson distribution: the count is the number of values of
the distribution function below that number. Rows are exploded by their counts and then shuffled
globally by the hash of id, copy and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import packed, unpacked
from plotlens.session import staged

#: A mean above this is drawn as the sum of several smaller ones, so that exp(-mean) stays above zero.
LARGEST_MEAN = 500.0
#: Sources up to which the rates are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits, the same in any SQL engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))


def poisson_steps(mean: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ... as far as it matters in doubles."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """``(source, n, mean)`` of every source. Without weights all sources weigh the same.

    A source that ``weights`` doesn't name has weight 0 and is left out of the mix; a null source
    is a source of its own.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    counts = staged(counts.withColumn("w", weight), "mixing-counts")
    n, total = counts.agg(F.sum("n"), F.sum("w")).first()
    return counts.select("source", "n", (F.lit(epochs * (n or 0)) * F.col("w") / F.lit(total or 1.0) / F.col("n")).alias("mean"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str | None = "copy",
) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (1, 2, ...), in a random global order.

    Rows repeated in full, and rows with a null id, draw the same count each. An empty table gives
    an empty result. Columns of the input keep names and values; if one is called like ``copy_col``,
    underscores are put behind the new one's name. With ``copy_col=None`` there is none.
    """
    of = staged(rates(docs, weights, epochs, source_col), "mixing-rates")
    small = of.count() <= BROADCAST_SOURCES
    parts_ = F.greatest(F.lit(1), F.ceil(F.col("mean") / LARGEST_MEAN)).cast("int")
    of = of.withColumn("parts", parts_).select(F.col("source").alias("of"), "parts", poisson_steps(F.col("mean") / F.col("parts")).alias("steps"))
    rows = packed(docs, id=id_col, source=source_col)
    id_ = F.coalesce(F.col("id").cast("string"), F.lit("null"))

    def drawn(part: Column) -> Column:
        u = uniform(id_, F.lit(seed), part)
        return F.size(F.filter("steps", lambda c: c < u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, part: acc + drawn(part))
    rows = rows.join(F.broadcast(of) if small else of, F.col("source").eqNullSafe(F.col("of"))).withColumn("count", count).where("count > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    rows = rows.withColumn("place", F.xxhash64(id_, F.lit(seed), "copy")).select("input", "copy", "place")
    rows = rows.repartition("place").sortWithinPartitions("place")
    out = unpacked(rows, docs.columns)
    if copy_col is not None:
        while copy_col.lower() in {c.lower() for c in docs.columns}:
            copy_col += "_"
        out.append(F.col("copy").alias(copy_col))
    return rows.select(*out)
