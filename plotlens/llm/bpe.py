"""Byte-level BPE: ranked merges folded by Spark higher-order functions over distinct words.

The fold is a column expression: a word's bytes (as hex digit pairs) are an array, each step looks
every adjacent pair up in the rank map, a literal dealt into buckets, and joins the leftmost pair
of the lowest rank. It runs on the distinct words that are most frequent in the corpus, up to a
bound: they are folded once and sent to the tasks as a dictionary, so that no row of words is
shuffled back to its document. The few words of a document that the dictionary lacks are merged
where they occur, long ones with a heap; folding them in every document's row took twice the time.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows, parts
from plotlens.session import staged

#: Words of the dictionary at most, each of ``DICT_BYTES`` bytes at most: under 40 MB in all.
DICT_WORDS, DICT_BYTES = 1 << 19, 64
#: Bytes from which a piece is merged with a heap.
LONG_PIECE = 256
#: Buckets of the rank map, by the CRC-32 of a piece's hex digits.
BUCKETS = 1 << 16
#: Bytes of text that are encoded at once.
SLICE = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 piece and its rank on each line. It is read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def rank_buckets(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal ``array<map<string,int>>``: hex digits to rank, by bucket."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        digits = piece.hex()
        buckets[zlib.crc32(digits.encode()) % BUCKETS][digits] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and that stands in the plan once if it is a literal."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_word(digits: Column, ranks: Column) -> Column:
    """The ids (``array<int>``) of the piece whose bytes are the hex ``digits``."""

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(ranks, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int") + 1), piece)

    def step(acc: Column, _: Column) -> Column:
        def merged(found: Column) -> Column:
            low = F.array_min(found)

            def joined(at: Column) -> Column:
                pair = F.concat(F.element_at(acc, at), F.element_at(acc, at + 1))
                return F.concat(F.slice(acc, 1, at - 1), F.array(pair), F.slice(acc, at + 2, F.size(acc)))

            return F.when(low.isNull(), acc).otherwise(_let(F.array_position(found, low).cast("int"), joined))

        n = F.size(acc) - 1
        pairs = F.zip_with(F.slice(acc, 1, n), F.slice(acc, 2, n), lambda a, b: rank(F.concat(a, b)))
        return F.when(n < 1, acc).otherwise(_let(pairs, merged))

    size = (F.length(digits) / 2).cast("int")
    split = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(digits, 2 * i - 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), size), split, step)
    whole = rank(digits)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank))


def _little(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""
    each = F.transform(
        ids,
        lambda i: F.concat(*[F.lpad(F.hex(F.shiftright(i, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]),
    )
    return F.unhex(F.array_join(each, ""))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long piece: a linked list of parts and a heap of (rank, place)."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def merge_word(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one short piece, with the same steps as ``fold_word``."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    find, none = ranks.get, len(ranks) + 1
    found = [find(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while found and (low := min(found)) < none:
        i = found.index(low)
        parts[i] += parts.pop(i + 1)
        del found[i]
        if i:
            found[i - 1] = find(parts[i - 1] + parts[i], none)
        if i < len(found):
            found[i] = find(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merged(piece: bytes, ranks: dict[bytes, int]) -> bytes:
    ids = merge_long(piece, ranks) if len(piece) > LONG_PIECE else merge_word(piece, ranks)
    return struct.pack(f"<{len(ids)}I", *ids)


def frequent_words(rows: DataFrame, pattern: str, limit: int = DICT_WORDS) -> DataFrame:
    """The most frequent matches of ``pattern`` in all texts, ``limit`` at most.

    Counts are combined in the map tasks. A small histogram of the counts sets the least count
    that keeps within the limit. What splits differently in Java than in the tasks below is
    merely not found in the dictionary.
    """
    words = rows.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.octet_length("word") <= DICT_BYTES)
    counts = staged(counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    least, held = None, 0
    for level, n in sorted(counts.groupBy("level").agg(F.count("*")).collect(), reverse=True):
        if held + n > limit:
            break
        least, held = level, held + n
    return counts.where(F.lit(False) if least is None else F.col("level") >= least).select("word")


def dictionary(rows: DataFrame, ranks: dict[bytes, int], pattern: str, limit: int = DICT_WORDS) -> dict[str, bytes]:
    """The frequent words with their ids as bytes; its size is bounded by the two limits above."""
    words = frequent_words(rows, pattern, limit)
    digits = F.lower(F.hex(F.encode("word", "UTF-8")))
    ids = _let(rank_buckets(ranks), lambda buckets: _little(fold_word(digits, buckets)))
    table = words.select("word", ids.alias("ids")).toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = DICT_WORDS,
    decoded: bool = False,
) -> DataFrame:
    """``(id, ids)``: the ids of each row's whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids; repeated rows give repeated rows; an empty
    table an empty result. With ``decoded``, the bytes of the decoded ids follow.
    """
    rows = input_rows(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast((dictionary(rows, ranks, pattern, limit), ranks))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank_of = held.value
        find, split = known.get, regex.compile(pattern).findall
        pieces = {i: p for p, i in rank_of.items()} if decoded else {}
        for whole in batches:
            for batch in parts(whole, 1, SLICE):
                ids = []
                for text in batch.column(1):
                    found = split(text.as_py() or "")
                    ids.append(b"".join([find(w) or _merged(w.encode(), rank_of) for w in found]))
                columns = [batch.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([_decode(i, pieces) for i in ids], pa.binary()))
                yield pa.record_batch(columns, names=["id", "ids", "decoded"][: len(columns)])

    return rows.mapInArrow(look_up, f"id {kind}, ids binary" + ", decoded binary" * decoded)


def _decode(ids: bytes, pieces: dict[int, bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I")))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``(id, decoded)``: the binary pieces of each row's ``ids``, concatenated; null ids give null."""
    kind = encoded.schema["id"].dataType.simpleString()
    pieces = encoded.sparkSession.sparkContext.broadcast({i: p for p, i in ranks.items()})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if i is None else _decode(i, pieces.value) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    return encoded.select("id", "ids").mapInArrow(each, f"id {kind}, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    out = encode(docs, ranks, id_col=id_col, text_col=text_col, decoded=True)
    return out.select(
        F.col("id").alias(id_col),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
