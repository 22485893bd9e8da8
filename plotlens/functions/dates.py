"""Lenient dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish month names in the genitive.
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "wrzesnia", "pazdziernika", "listopada", "grudnia")


def iso_prefix(text: Column) -> Column:
    """The date that a text starts with; whatever follows is ignored."""
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def long_polish(text: Column) -> Column:
    """``10 sierpnia 2026``."""
    from plotlens.functions.text import fold

    low = F.lower(fold(text))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, r"[0-9]{1,2}\s+([a-z]+)\s+[0-9]{4}", 1))
    parts = [F.regexp_extract(low, r"[a-z]+\s+([0-9]{4})", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, r"([0-9]{1,2})\s+[a-z]+", 1), 2, "0")]
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def slashed(text: Column) -> Column:
    """``2026/08/10`` with or without a time."""
    return F.try_to_date(F.replace(F.substring(F.trim(text), 1, 10), F.lit("/"), F.lit("-")), "yyyy-MM-dd")
