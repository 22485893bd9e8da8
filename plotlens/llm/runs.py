"""Periodic runs of words, by Lyndon arrays from Baier's grouping and longest common extensions.

A run is a stretch that repeats with a smallest period and can't be made longer. Under one of the
two orders of the alphabet, every run holds a Lyndon word as long as its period that is the longest
Lyndon word at its start. Phase one of Baier's suffix sorter groups suffixes by just these words:
from the highest group down, the members of a group hand their context to the nearest place on
their left that is in a lower group, which moves up behind its own group. When a group's turn
comes, the length of its context is its members' entry of the Lyndon array. Places whose word
follows itself are extended both ways as far as words agree.

Long repeats are rare, so the grouping only sees stretches where each three words were seen shortly
before, as all but the first period of a run were; the bound is exact, so no run is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows, parts, word_array, words

#: The shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that a stretch is looked for by.
GRAM = 3
#: Bytes of text that are handled at once, one text at least.
BATCH_BYTES = 8 << 20


def lyndon_array(s: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place, by Baier's grouping; the end of the text is smaller than any letter.

    ``left`` leads from a place to the nearest one at or before it that is still to come; groups
    form a list from low to high, and a place that is handed a context k times moves k groups up.
    """
    n = len(s)
    letters = sorted(set(s))
    order = {c: g for g, c in enumerate(letters)}
    group = [order[c] for c in s]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    lower = [g - 1 for g in range(len(letters))]
    higher = [g + 1 for g in range(len(letters))]
    higher[-1:] = [-1] * bool(letters)
    left = list(range(-1, n))  # left[i + 1] is about place i; -1 is the end
    size = [1] * n
    out = [0] * n
    now = len(letters) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        for i in own:
            left[i + 1] = i - 1
            out[i] = size[i]
        handed: dict[int, int] = {}
        for i in own:  # from left to right, so the last one decides where a context ends
            j = i
            while left[j + 1] != j:
                left[j + 1] = left[left[j + 1] + 1]
                j = left[j + 1]
            if j >= 0:
                handed[j] = handed.get(j, 0) + 1
                size[j] = i + size[i] - j
        moves: dict[tuple[int, int], list[int]] = {}
        for j, k in handed.items():
            moves.setdefault((k, group[j]), []).append(j)
        for (_, old), moved in sorted(moves.items(), key=lambda x: -x[0][0]):
            new = len(lower)
            lower.append(old)
            higher.append(higher[old])
            if higher[old] >= 0:
                lower[higher[old]] = new
            higher[old] = new
            members.append(moved)
            for j in moved:
                group[j] = new
        now = lower[now]
    return out


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Parts of the text that hold every run that is long enough; most texts have none.

    Behind its first period q, each three words of a run were seen at most q words before. So for
    each power of two at least q, a run covers so many places in a row of that kind, and begins at
    most so far before them.
    """
    n = len(ids) - GRAM + 1
    if len(ids) < LEAST_WORDS:
        return []
    mix = np.uint64(0x9E3779B97F4A7C15)
    x = ids.astype(np.uint64) + np.uint64(1)
    gram = x[:n].copy()
    for k in range(1, GRAM):
        gram = (gram * mix) ^ (gram >> np.uint64(29)) ^ x[k : n + k]  # equal hashes of unlike words cost time only
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return []
    far = np.full(n, n, np.int64)
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, scale = [], 1
    while LEAST_PERIODS * (scale // 2 + 1) <= len(ids) or scale == 1:
        least = scale // 2 + 1
        need = max(LEAST_WORDS, LEAST_PERIODS * least) - least - GRAM + 1
        edge = np.flatnonzero(np.diff(np.concatenate(([False], far <= scale, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long_ = ends - starts >= need
        found += [(max(0, a - scale), b + GRAM - 1) for a, b in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True)]
        scale *= 2
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def common_extension(a: np.ndarray, b: np.ndarray) -> int:
    """Words that agree from the start, by blocks that double."""
    n, at, block = min(len(a), len(b)), 0, 16
    while at < n:
        to = min(n, at + block)
        differ = a[at:to] != b[at:to]
        if differ.any():
            return at + int(differ.argmax())
        at, block = to, 2 * block
    return n


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a text of word numbers, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    for a, b in stretches(ids):
        part = ids[a:b]
        for letters in (part, -part):
            size = np.array(lyndon_array(letters.tolist()), np.int64)
            next_ = np.minimum(np.arange(len(size)) + size, len(size) - 1)
            ends: dict[int, int] = {}
            for i in np.flatnonzero((size[next_] == size) & (np.arange(len(size)) + 2 * size <= len(size))).tolist():
                p = int(size[i])
                i += a
                if i + 2 * p <= ends.get(p, 0):  # in a run that is known
                    continue
                to = i + p + common_extension(ids[i:], ids[i + p :])
                if to < i + 2 * p:
                    continue
                start = i - common_extension(ids[:i][::-1], ids[: i + p][::-1])
                ends[p] = to
                if to - start >= max(least_words, least_periods * p):
                    found.add((start, to - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut down to its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def _of(text: bytes | None) -> tuple:
    found = words(text)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    runs = runs_of(ids)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{length},{p}\n" for a, length, p in runs)
    kept = b" ".join(w for w, stays in zip(found, collapsed(len(found), runs).tolist(), strict=True) if stays) if runs else b" ".join(found)
    return len(runs), *longest, listed, kept


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``(id, n_runs, start, length, period, runs, collapsed)``.

    ``runs`` lists ``start,length,period`` in lines, by start, then period; the three columns are
    those of the longest run, of several that of the smallest start, then period, and null without
    one. ``collapsed`` is the text with each run cut down to its first period. A null or empty text
    has no runs; repeated rows and null ids give a row each; an empty table gives an empty result.
    A text is handled whole, however long, in a task that holds a few numbers for each of its words.
    """
    rows = input_rows(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    names = ("n_runs", "start", "length", "period", "runs", "collapsed")
    types = (*[pa.int64()] * 4, pa.string(), pa.string())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, BATCH_BYTES):
                out = [_of(t.as_py()) for t in part.column(1).cast(pa.large_binary())]
                columns = [pa.array([r[k] for r in out], t if k < 5 else pa.binary()).cast(t) for k, t in enumerate(types)]
                yield pa.record_batch([part.column(0), *columns], names=["id", *names])

    return rows.mapInArrow(each, f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, runs string, collapsed string")


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` where one document of ten repeats a part of itself from some word on, by the CRC of its id; a null id leaves the text as it is."""
    rows = input_rows(docs, id=id_col, text=text_col)
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    a = F.col("a")
    looped = F.transform("w", lambda w, i: F.when(i < a, w).otherwise(F.get("w", (a + (i - a) % F.col("p")).cast("int"))))
    changed = rows.withColumns({"h": h, "w": F.when(h % 10 == 0, word_array(F.col("text")))}).withColumn("a", F.when(n > 0, g % n))
    changed = changed.withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)))
    return changed.select("id", F.when(a.isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of every document of ``with_loops`` as counts, the longest one and digests."""
    out = find_runs(with_loops(docs, id_col, text_col), "id", "text")
    return out.select(
        F.col("id").alias(id_col), "n_runs", "start", "length", "period", F.floor(F.col("length") * 1000 / F.col("period")).alias("exponent_milli"),
        F.sha2(F.encode("runs", "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
