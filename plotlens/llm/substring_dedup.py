"""Substring dedup by seed and extend: repeated passages of many words are removed from later documents.

Anchors are winnowed: of the hashes of all ``ANCHOR``-word grams in a window of ``window`` words the
smallest, and of equal ones the last, is the window's anchor, so two equal windows have the same
anchor at the same place. The windows of a document with one anchor in a row form a segment.
Documents meet on the anchors that two of them at least hold. Segments of equal words form a class,
whose smallest document covers all others of it. Classes of one anchor differ at the ends of
repeats: each is joined with the anchor's leader, the class of the smallest document, and the match
is extended word by word to the left and to the right of the anchor; it covers the windows that lie
in it whole. What the leader does not cover may still occur in a third class: only those windows
are compared one by one. Covered windows that touch are joined to maximal repeats, of ``window``
words at least. No step pairs all documents of an anchor, and each minimum is combined in the map
tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows, words
from plotlens.session import drop_staged, staged

#: Words of an anchor gram. Fewer make fewer segments and more windows at each end of a repeat.
ANCHOR = 8
#: Words of a window.
WINDOW = 50
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    """Word to 64-bit hash, for as many words as are worth remembering."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Hasher:
    """Hashes of word sequences by their bounds, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self):
        self.known = _Hashes()
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def load(self, text: bytes | None) -> int:
        """Take a text; return its number of words."""
        found = words(text)
        n = len(found)
        self.words = h = np.fromiter(map(self.known.__getitem__, found), np.uint64, n)
        self.take(h)
        return n

    def take(self, h: np.ndarray) -> None:
        """Take the word hashes of a text or of a part of one."""
        n = len(h)
        self._powers(n + 1)
        self.sums = []
        for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)):
            mixed = (h ^ (h >> np.uint64(31))) * salt
            mixed ^= mixed >> np.uint64(29)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * self.up[:n], dtype=np.uint64))))

    def of(self, which: int, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        out = (self.sums[which][hi] - self.sums[which][lo]) * self.down[lo]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        return out ^ (out >> np.uint64(29))

    def anchors(self, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window and its place: the last of the smallest gram hashes, by doubling the reach."""
        low = self.of(0, slice(0, n - ANCHOR + 1), slice(ANCHOR, n + 1))
        at = np.arange(len(low), dtype=np.int32)
        reach, width = 1, window - ANCHOR + 1
        while reach < width:
            step = min(reach, width - reach)
            later = low[step:] <= low[:-step]
            low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
            reach += step
        return low, at

    def segments(self, n: int, window: int) -> tuple[np.ndarray, ...]:
        """Anchor, content hash, first window, number of windows and the anchor's place of each segment."""
        anchor, at = self.anchors(n, window)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.append(first, len(at)))
        content = self.of(1, first, first + count + window - 1) ^ (count.astype(np.uint64) * _BASE)
        return anchor[first], content, first, count, at[first]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, doc, h, text)``: the id, as a number in whose order a null one is last, and a hash that tells rows of one id apart."""
    rows = input_rows(docs, id=id_col, text=text_col)
    rows = rows.select("id", F.coalesce(F.col("id").cast("bigint"), F.lit(2**63 - 1)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.select("id", "doc", F.xxhash64("text").alias("h"), "text")


def find_segments(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(anchor, content, doc, h, first, count, at)`` of every segment of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(2)):
                n = hasher.load(text.as_py())
                if n >= window:
                    found = hasher.segments(n, window)
                    for part, values in zip(parts, (*found, np.full(len(found[0]), i)), strict=True):
                        part.append(values)
            if parts[0]:
                anchor, content, first, count, at, row = map(np.concatenate, parts)
                row = pa.array(row)
                yield pa.record_batch(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row),
                        pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(at, pa.int32()),
                    ],
                    names=["anchor", "content", "doc", "h", "first", "count", "at"],
                )

    return rows.mapInArrow(each, "anchor bigint, content bigint, doc bigint, h bigint, first int, count int, at int")


def find_classes(segments: DataFrame) -> DataFrame:
    """``(anchor, content, low, rep, n, leads)``: the classes of each anchor, their smallest document and its segment.

    ``n`` counts the anchor's classes; the leader is that of the smallest document.
    """
    rep = F.min(F.struct("doc", "h", "first", "count", "at")).alias("rep")
    classes = staged(segments.groupBy("anchor", "content").agg(rep), "classes")
    of = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.struct("rep.doc", "content")).alias("leader"))
    of = staged(of.where("n > 1"), "anchors-of-classes")
    joined = classes.hint("merge").join(of, "anchor", "left")
    out = staged(joined.select("anchor", "content", F.col("rep.doc").alias("low"), "rep", "n", (F.col("leader.content") == F.col("content")).alias("leads")), "classes-led")
    drop_staged(classes, of)
    return out


def _contexts(rows: DataFrame, window: int) -> DataFrame:
    """``(anchor, content, doc, n, leads, before, words)``: a wanted segment's word hashes and how many stand before its anchor."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = ["anchor", "content", "doc", "n", "leads", "before", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, wanted = (c[i].as_py() for c in batch.columns)
                hasher.load(text)
                out = [
                    (w["anchor"], w["content"], doc, w["n"], w["leads"], w["at"] - w["first"], hasher.words[w["first"] : w["first"] + w["count"] + window - 1].tobytes())
                    for w in wanted
                ]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(each, "anchor bigint, content bigint, doc bigint, n bigint, leads boolean, before int, words binary")


def extend(a: np.ndarray, before_a: int, b: np.ndarray, before_b: int) -> tuple[int, int]:
    """The words of ``a`` from the first to behind the last that match ``b`` around the anchors without a gap."""
    k = min(before_a, before_b)
    other = np.flatnonzero(a[before_a - k : before_a] != b[before_b - k : before_b])
    left = k - 1 - int(other[-1]) if len(other) else k
    k = min(len(a) - before_a, len(b) - before_b)
    other = np.flatnonzero(a[before_a : before_a + k] != b[before_b : before_b + k])
    right = int(other[0]) if len(other) else k
    return before_a - left, before_a + right


def _extended(pairs: DataFrame, window: int) -> DataFrame:
    """``(anchor, content, doc, first, count, hash)``: the windows of each pair's segment, counted from its first.

    A run that the leader covers has no hash; single windows that it does not cover have theirs,
    if the anchor has a third class.
    """
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("hash", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out: list[tuple] = []
            for anchor, content, doc, n, before, words_, before_l, words_l in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(words_, np.uint64)
                windows = len(own) - window + 1
                lo, hi = extend(own, before, np.frombuffer(words_l, np.uint64), before_l) if before_l is not None else (0, 0)
                count = max(0, hi - lo - window + 1)
                if count:
                    out.append((anchor, content, doc, lo, count, None))
                if n > 2 and count < windows:
                    hasher.take(own)
                    hashes = hasher.of(1, slice(0, windows), slice(window, None)).view(np.int64).tolist()
                    out += [(anchor, content, doc, i, 1, hashes[i]) for i in range(windows) if not lo <= i < lo + count]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pairs.mapInArrow(each, "anchor bigint, content bigint, doc bigint, first int, count int, hash bigint")


def covered_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc, h, first, count)``: runs of windows whose words also start in a document with a smaller id."""
    all_segments = staged(find_segments(rows.select("doc", "h", "text"), window), "segments")
    shared = all_segments.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    shared = staged(shared, "shared-anchors")
    segments = staged(all_segments.hint("merge").join(shared, "anchor", "left_semi"), "shared-segments")
    drop_staged(all_segments, shared)
    classes = find_classes(segments)

    wanted = F.struct("anchor", "content", "n", "leads", "rep.first", "rep.count", "rep.at")
    wanted = classes.where("n > 1").groupBy(F.col("rep.doc").alias("doc"), F.col("rep.h").alias("h")).agg(F.collect_list(wanted).alias("wanted"))
    contexts = rows.join(wanted.hint("shuffle_hash"), ["doc", "h"]).select("doc", "text", "wanted")
    contexts = staged(_contexts(contexts, window), "contexts")
    leaders = contexts.where("leads").select("anchor", F.col("doc").alias("doc_l"), F.col("before").alias("before_l"), F.col("words").alias("words_l")).dropDuplicates(["anchor"])
    pairs = contexts.where("not leads").hint("merge").join(leaders, "anchor")
    meets = F.col("doc") > F.col("doc_l")
    pairs = pairs.select("anchor", "content", "doc", "n", "before", "words", F.when(meets, F.col("before_l")).alias("before_l"), F.when(meets, F.col("words_l")).alias("words_l"))
    found = staged(_extended(pairs, window), "extended")
    drop_staged(contexts)

    single = found.where("hash is not null")
    least = staged(single.groupBy("anchor", "hash").agg(F.min("doc").alias("low")), "window-contents")
    rest = single.hint("merge").join(least, ["anchor", "hash"]).where("doc > low")
    runs = found.where("hash is null").select("anchor", "content", "first", "count").union(rest.select("anchor", "content", "first", "count"))
    runs = staged(runs.groupBy("anchor", "content").agg(F.collect_set(F.struct("first", "count")).alias("runs")), "class-runs")
    drop_staged(found, least)
    of = staged(classes.select("anchor", "content", "low").hint("merge").join(runs, ["anchor", "content"], "left"), "class-results")
    drop_staged(classes, runs)
    seen = segments.hint("merge").join(of, ["anchor", "content"])
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("count").alias("count")))
    seen = seen.select("doc", "h", F.col("first").alias("at"), F.explode(F.when(F.col("doc") > F.col("low"), whole).otherwise(F.col("runs"))).alias("run"))
    out = staged(seen.select("doc", "h", (F.col("at") + F.col("run.first")).alias("first"), F.col("run.count").alias("count")), "covered")
    drop_staged(segments, of)
    return out


def maximal_repeats(runs: list[dict]) -> list[dict]:
    """Runs of covered windows as ``{start, end}`` of words, joined where they touch."""
    out: list[dict] = []
    for run in sorted(runs, key=lambda r: r["start"]):
        if out and out[-1]["end"] >= run["start"]:
            out[-1]["end"] = max(out[-1]["end"], run["end"])
        else:
            out.append(dict(run))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``repeats``.

    A null text has no words. Rows of one id are one document: they cover nothing in each other,
    and rows repeated in full give equal results. Texts under ``window`` words lose nothing. An
    empty table gives an empty result.
    """
    rows = _keyed(docs, id_col, text_col)
    covered = covered_windows(rows, window)
    run = F.struct(F.col("first").alias("start"), (F.col("first") + F.col("count") + window - 1).alias("end"))
    runs = staged(covered.groupBy("doc", "h").agg(F.collect_set(run).alias("runs")), "runs")
    drop_staged(covered)
    joined = rows.join(runs.hint("shuffle_hash"), ["doc", "h"], "left").select("id", "text", "runs")

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_hash, repeats = [], [], [], []
            for text, covered in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = words(text.as_py())
                kept, at = [], 0
                repeats.append(maximal_repeats(covered or []))
                for run in repeats[-1]:
                    kept += found[at : run["start"]]
                    at = run["end"]
                kept += found[at:]
                n_words.append(len(found))
                n_removed.append(len(found) - len(kept))
                kept_hash.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_hash), pa.array(repeats, kind)]
            yield pa.record_batch(columns, names=["id", "n_words", "n_removed", "kept_sha256", "repeats"])

    spans = "array<struct<start:int,end:int>>"
    kind_of_id = rows.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(each, f"id {kind_of_id}, n_words bigint, n_removed bigint, kept_sha256 string, repeats {spans}")
    return out.withColumnRenamed("id", id_col)
