"""Fill-in-middle transformation on an indexable skip list.

A text is a list of units, by default its code points. The list has express lanes over every unit
that a fair enough coin promotes; each lane's step carries how many units and how many code points
it skips. A cut is a rank of units: descending from the top lane, a step is taken while the units
passed so far and its width stay within the rank, so the code points passed are the exact place of
the cut. What lies between two cuts becomes the middle, and prefix, suffix and middle are written
behind their marks, in one of two orders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows, parts

#: The marks of prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
#: Of a hundred texts, those cut at all, and of a hundred cut ones those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: One of so many units of a lane is in the lane above.
STEP_BITS = 4
#: Bytes of text that are handled at once, one text at least.
BATCH_BYTES = 8 << 20


@lru_cache(1)
def _heights(size: int) -> np.ndarray:
    """Lanes above the lowest that each of ``size`` units is in, by a coin hashed from its number."""
    x = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    low = x & (~x + np.uint64(1))  # the lowest bit that is set
    return (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // STEP_BITS).astype(np.int8)


class SkipList:
    """Units of the given widths in code points, with lanes ``(units, points, down)`` from the lowest up.

    Step k of a lane skips ``units[k]`` units and ``points[k]`` code points; ``down[k]`` is the step
    of the lane below that starts at the same unit.
    """

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        place = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
        heights = _heights(1 << max(10, n.bit_length()))[:n]
        at = np.arange(n)
        self.lanes = [(np.ones(n, np.int64), np.asarray(widths), at)]
        while n and len(at) > 2:
            above = at[heights[at] >= len(self.lanes)]
            above = above if len(above) and not above[0] else np.concatenate(([0], above))  # every lane starts at the head
            if len(above) == len(at):
                break
            ends = np.append(above[1:], n)
            self.lanes.append((ends - above, place[ends] - place[above], np.searchsorted(at, above)))
            at = above

    def seek(self, rank: int) -> tuple[int, int]:
        """Units and code points before the cut of that rank: the rank itself, or all units if there are fewer."""
        passed = chars = k = 0
        for units, points, down in reversed(self.lanes):
            while k < len(units) and passed + units[k] <= rank:
                passed += int(units[k])
                chars += int(points[k])
                k += 1
            if k == len(units):  # the end of every lane is the end of the text
                break
            k = int(down[k])
        return passed, chars


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of each unit: of each match of ``unit`` from left to right, and of what is between matches; of each code point without a pattern."""
    if unit is None:
        return np.ones(len(text), np.int64)
    bounds = sorted({0, len(text), *(b for m in unit.finditer(text) for b in m.span())})
    return np.diff(np.array(bounds, np.int64))


def _numbers(id_: object, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'null' if id_ is None else id_}".encode()).hexdigest()
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(text: str, id_: object, seed: int = 1, unit: re.Pattern | None = None) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text; ``n`` counts units."""
    h1, h2, h3, h4 = _numbers(id_, seed)
    widths = unit_widths(text, unit)
    n = len(widths)
    if not n or h3 % 100 >= CUT or P in text or S in text or M in text:
        return n, "plain", None, None, text
    units = SkipList(widths)
    (_, a), (_, b) = sorted(units.seek(h % (n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return n, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str | None = None) -> DataFrame:
    """A row per document: ``(id, n, form, prefix_chars, middle_chars, output)``.

    Cuts, form and order come from a hash of seed and id, so repeated rows give repeated results; a
    null id hashes like the word ``null``. A null text is an empty one. An empty text and one that
    holds a mark stay plain, and plain texts have no lengths. Two equal cuts give an empty middle.
    With a pattern ``unit`` cuts fall between its matches only. Long texts are cut whole; an empty
    table gives an empty result; other columns are not read.
    """
    rows = input_rows(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = None if unit is None else re.compile(unit)
        for batch in batches:
            for part in parts(batch, 1, BATCH_BYTES):
                out = [cut(t or "", i, seed, pattern) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.record_batch([part.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(each, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, natively: no text with a mark in it is ever cut, so each mark is found once."""
    first, second = F.when(form == "psm", S).otherwise(P), F.lit(M)
    body = F.substr(output, F.lit(len(P) + 1))
    at = F.instr(body, first)
    ahead, rest = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(S))
    to = F.instr(rest, second)
    behind, middle = F.substr(rest, F.lit(1), to - 1), F.substr(rest, to + len(M))
    return F.when(form == "plain", output).when(form == "psm", F.concat(ahead, middle, behind)).otherwise(F.concat(behind, middle, ahead))


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lengths and digests of every transformed document, and the digest of the text rebuilt from it."""
    out = fill_in_middle(docs, id_col, text_col)
    return out.select(
        F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256).alias("restored_sha256"),
    )
