"""Area levels by code prefix: 7 digits a municipality, 4 a county, 2 a voivodeship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels from local to wide, and the digits of their codes.
LEVELS = (("gmina", 7), ("powiat", 4), ("wojewodztwo", 2))


def at_levels(df: DataFrame, code: str) -> DataFrame:
    """Each row once for every level, with ``level`` and ``area``; rows without a code are left out."""
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.substring(code, 1, n).alias("area")) for level, n in LEVELS])
    return df.where(F.col(code).isNotNull()).withColumn("__at", F.explode(levels)).select(*df.columns, "__at.level", "__at.area")


def look_up(df: DataFrame, code: str, areas: DataFrame, name: str, on: list[str] | None = None) -> DataFrame:
    """Join ``areas`` (``level, area, ...``) three times, by prefix: columns ``name_gmina`` and so on hold its row as a struct.

    An area table has a row for each area, so Spark broadcasts it where it is small.
    """
    keys = on or []
    for level, n in LEVELS:
        part = areas.where(F.col("level") == level).select(
            F.col("area").alias("__area"), *[F.col(k).alias(f"__{k}") for k in keys], F.struct(*areas.columns).alias(f"{name}_{level}")
        )
        condition = F.substring(code, 1, n) == F.col("__area")
        for k in keys:
            condition &= F.col(k) == F.col(f"__{k}")
        df = df.join(part, condition, "left").drop("__area", *[f"__{k}" for k in keys])
    return df


def most_local(name: str, usable) -> Column:
    """The struct of the most local level that ``usable`` accepts; null if none."""
    return F.coalesce(*[F.when(usable(F.col(f"{name}_{level}")), F.col(f"{name}_{level}")) for level, _ in LEVELS])
