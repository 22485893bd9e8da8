"""All queries of the library and their SQL, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotlens.plans import cards, duplicates, enrichment, layers, market, scoring, streams, surfaces, tables, valuation

MODULES = [market, valuation, scoring, duplicates, surfaces, streams, layers, enrichment, cards, tables]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
