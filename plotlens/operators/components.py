"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlens.session import drop_staged, staged

MAX_ROUNDS = 60


def _star(pairs: DataFrame, low: str) -> tuple[DataFrame, DataFrame]:
    """Link the neighbours ``v`` of each ``u`` to the smallest of them and ``u``; and the table of minima.

    The minima are staged under the name ``low``, so that the join below stands between two plain
    exchanges and a hub's rows can be split.
    """
    least = staged(pairs.groupBy("u").agg(F.min("v").alias("m")), low)
    return pairs.join(least, "u").select("u", "v", F.least("m", "u").alias("m")), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; ``root`` is the smallest node reachable.

    Each round replaces an edge set by a flatter one with the same components (large star,
    then small star); it ends when the edges no longer change. Only a count and a sum of
    hashes reach the driver. Self-loops and null ends are ignored; an empty table gives none.
    """
    now = staged(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, low = _star(both, "large")
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large-edges")
        drop_staged(now, low)
        small, low = _star(large, "small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "small-edges")
        drop_staged(large, low)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").union(stars.select(F.col("root").alias("node"), "root").distinct())
