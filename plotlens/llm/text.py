"""Shared small parts: the white space and words of the contracts, and Arrow batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The characters that separate words and that exact dedup deletes.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: ``bytes.split()`` without arguments splits on exactly these six; ``str.split()`` does not.
SPLIT = r"[\x20\x09-\x0D]+"


def words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text."""
    return (text or b"").split()


def without_spaces(text: Column) -> Column:
    """``text`` without any of ``SPACES``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_array(text: Column) -> Column:
    """The words of ``text`` as an array, natively; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(each, schema)


def input_rows(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns under the operator's own names, whatever else ``df`` holds."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def packed(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` as one struct ``input`` beside copies of the named columns: helpers added later can't clash with a column of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"), *[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def unpacked(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns that ``packed`` put into ``input``, for a select."""
    return [F.col("input").getField(c).alias(c) for c in columns]


def parts(batch: pa.RecordBatch, place: int, most: int, field: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with ``most`` bytes at most in the text column at ``place``, or in a field of the struct there; one row at least."""
    texts = batch.column(place) if field is None else batch.column(place).field(field)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
