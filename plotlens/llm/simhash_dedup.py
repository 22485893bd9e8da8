"""SimHash near-dedup with bit-sliced comparison of fingerprints.

A document's fingerprint is the majority of the XXH64 hashes of its four-word shingles. Distinct
fingerprints meet in buckets that agree on some of their blocks of bits: two that differ in at
most ``radius`` bits agree on all bits of at least ``blocks - radius`` blocks, so one bucket for
each choice of so many blocks misses no link. Within a bucket, bit planes are stored vertically,
one bit for each fingerprint; a fingerprint is held against all later ones at once by adding the
planes of differing bits into carry-save counters, and a comparison is abandoned once every lane
exceeds the radius. Links join a bucket-local forest, so a bucket of n emits fewer than n edges;
what a forest holds together already is not compared again.

``keep_one_of_each`` compares fingerprints of 512 bits over sets of five-word shingles, at the
radius of texts that have 0.92 of their words in common. So far apart, no block of bits would be
selective: documents meet where both smallest shingle hashes of one of 20 groups agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from plotlens.llm.text import input_rows, map_batches, packed, unpacked, words
from plotlens.operators.components import connected_components
from plotlens.session import staged

BITS, SHINGLE, SEED, RADIUS = 64, 4, 42, 4
#: Bits and words of a shingle of the wide fingerprints that ``keep_one_of_each`` compares, and the share of words that near copies have in common at least.
WIDE, WIDE_SHINGLE, LIKENESS = 512, 5, 0.92
#: Groups of smallest hashes in which documents meet, and hashes of a group: a pair at the bound is missed once in 200.
BANDS, BAND = 20, 2
#: What tells the parts of a wide fingerprint apart, and odd factors that give each smallest hash an order of its own.
_LANES = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([k]), 1) | 1 for k in range(BANDS * BAND)], np.uint64)
#: Fingerprints of a bucket that are compared in one piece; larger buckets are dealt out in pairs of pieces.
PIECE = 4096
#: A shingle table of a document is summed in parts of so many shingles.
PART = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer; 0 for a text without words."""
    found = words(text.lower() if text else None)  # bytes.lower() changes A-Z only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(found) - size + 1
    h, digest = np.empty(n, "<u8"), xxhash.xxh64_intdigest
    h[:] = [digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, PART):
        part = np.unpackbits(h[i : i + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    fp = np.fromiter((fingerprint(t.as_py()) for t in texts.cast(pa.large_binary())), np.uint64, len(texts))
    return pa.array(fp.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; null texts count as empty. ``fp`` holds the 64 bits as a signed long."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), _fingerprints(batch.column(1))], names=["id", "fp"])

    rows = input_rows(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, each, f"id {kind}, fp bigint")


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` of the blocks, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(each, blocks - radius)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def choose_blocks(n: int, radius: int) -> int:
    """The fewest blocks, but two more than the radius at least, that leave under 64 random fingerprints in a bucket."""
    blocks = radius + 2
    while blocks < 2 * radius and n > 64 * 2 ** (BITS * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def _planes(values: list[int], bits: int = BITS) -> list[int]:
    """Bit planes: bit i of plane b is bit b of value i."""
    table = np.frombuffer(b"".join(v.to_bytes(bits // 8, "little") for v in values), np.uint8).reshape(-1, bits // 8)
    packed_ = np.packbits(np.unpackbits(table, axis=1, bitorder="little"), axis=0, bitorder="little")
    return [int.from_bytes(packed_[:, b].tobytes(), "little") for b in range(bits)]


def near_lanes(value: int, planes: list[int], lanes: int, radius: int, order: list[int]) -> int:
    """The lanes (a bit each) whose values differ from ``value`` in at most ``radius`` bits.

    ``planes`` are added into carry-save counters of as many bits as the radius needs, preset so
    that the carry out of the last one marks a lane beyond the radius.
    """
    width = (radius + 1).bit_length()
    preset = (1 << width) - radius - 1
    counters = [lanes if preset >> k & 1 else 0 for k in range(width)]
    alive = lanes
    for i, b in enumerate(order):
        carry = (planes[b] ^ lanes if value >> b & 1 else planes[b]) & alive
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        alive &= ~carry
        if i & 7 == 7 and not alive:
            break
    return alive


def _link(values: list[int], order: list[int], sides: list[int] | None, radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """The edges (place, root's place) of a bucket's forest. ``sides``: only values of unlike sides are compared, if given.

    ``order`` has the bits that may differ. Members of a tree are lanes of a mask, and no value is
    held against its own tree: a large group of near copies costs a pass, not a pass for each.
    """
    n = len(values)
    root, members = list(range(n)), [1 << i for i in range(n)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    planes = _planes(values, bits)
    split = sum(s << i for i, s in enumerate(sides)) if sides else 0
    whole = (1 << n) - 1
    for i in range(n - 1):
        lanes = whole >> (i + 1) << (i + 1) & ~members[find(i)]
        if sides:
            lanes &= ~split if split >> i & 1 else split
        near = near_lanes(values[i], planes, lanes, radius, order) if lanes else 0
        while near:
            a, b = find(i), find((near & -near).bit_length() - 1)
            low, high = min(a, b), max(a, b)
            root[high] = low
            members[low] |= members[high]
            members[high] = 0
            near &= ~members[low]
    return [(i, find(i)) for i in range(n) if find(i) != i]


def _bucket_edges(batches: Iterator[pa.RecordBatch], orders: list[list[int]], radius: int, bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """Edges of buckets that arrive sorted; a bucket holds ``2 * PIECE`` fingerprints or so at most."""
    key, nodes, values, sides = None, [], [], []
    out: list[tuple[int, int]] = []

    def close():
        if len(values) > 1:
            mixed = sides if key[2] != key[3] else None
            out.extend((nodes[a], nodes[b]) for a, b in _link(values, orders[key[0] % len(orders)], mixed, radius, bits))

    def flush():
        edges = np.array(out, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for t, k, i, j, side, node, fp in zip(*columns, strict=True):
            if (t, k, i, j) != key:
                close()
                key, nodes, values, sides = (t, k, i, j), [], [], []
            nodes.append(node)
            values.append(int.from_bytes(fp, "little") if isinstance(fp, bytes) else fp % (1 << BITS))
            sides.append(side)
        if len(out) > 50_000:
            yield flush()
            out = []
    close()
    yield flush()


def bucket_edges(keyed: DataFrame, orders: list[list[int]], radius: int, bits: int = BITS, piece: int = PIECE) -> DataFrame:
    """``(a, b)`` edges of all buckets ``(t, k)`` of ``(t, k, node, fp)``.

    Buckets of one fingerprint end in the count of their sizes. A bucket over ``piece`` is dealt
    into parts by a hash, and each pair of parts is compared in a task of its own.
    """
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    large = staged(sizes.where(F.col("n") > piece).select("t", "k", F.ceil(F.col("n") / piece).cast("int").alias("parts")), "large-buckets")
    keyed = keyed.hint("merge").join(large, ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j"), (F.col("part") > o).cast("int").alias("side")),
    )
    dealt = keyed.select("t", "k", "node", "fp", F.explode(pairs).alias("p")).select("t", "k", "p.i", "p.j", "p.side", "node", "fp")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "node")
    return dealt.mapInArrow(lambda batches: _bucket_edges(batches, orders, radius, bits), "a bigint, b bigint")


def near_edges(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, piece: int = PIECE) -> DataFrame:
    """``(a, b)`` edges that connect the distinct fingerprints ``fp`` within the radius."""
    distinct = distinct.select("fp")
    blocks = blocks or choose_blocks(distinct.count(), radius)
    masks = block_masks(radius, blocks)
    assert len(masks) == comb(blocks, radius)
    orders = [[b for b in range(BITS) if not m >> b & 1] for m in masks]  # all of a bucket agree on the other bits
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)]))
    keyed = distinct.select("fp", table.alias("bucket")).select("bucket.t", "bucket.k", F.col("fp").alias("node"), "fp")
    return bucket_edges(keyed, orders, radius, BITS, piece)


def fingerprint_roots(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``distinct`` fingerprints ``fp`` with the ``root`` of the group that each of them links to."""
    roots = connected_components(near_edges(distinct, radius))
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left")
    return joined.select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach.
    Null texts count as empty, and empty texts (fingerprint zero) link like any other. Repeated
    rows and equal texts share a fingerprint. A null id is in its group but is never the smallest;
    a group of null ids only has a null ``component_id``. An empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    joined = fingerprint_roots(distinct, radius)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(joined.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.hint("merge").join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def wide_radius(likeness: float = LIKENESS) -> int:
    """Bits of ``WIDE`` that are expected to differ between texts that share so many of their words.

    A shingle stays if all its words do, so the cosine of the shingle sets is that share to the power of a shingle's words.
    """
    return int(WIDE * acos(likeness**WIDE_SHINGLE) / pi)


def _mixed(h: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sketch(text: bytes | None, size: int = WIDE_SHINGLE, seed: int = SEED) -> tuple[bytes, list[int]]:
    """The wide fingerprint of a text's set of shingles, and the hash of each group of its smallest shingle hashes.

    A text of fewer words is one shingle; one without words has zeros throughout.
    """
    found = words(text.lower() if text else None)
    if not found:
        return bytes(WIDE // 8), [0] * BANDS
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n]
    h = np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[min(size, len(found)) - 1 :] - 1).tolist(), strict=True)), np.uint64, n))
    ones, least = np.zeros(WIDE, np.int64), np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1020):
        part = h[at : at + 1020, None]
        bits = np.unpackbits(_mixed(part + _LANES).view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(part), 255):  # sums of 255 bits fit in a byte
            ones += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
        least = np.minimum(least, (part * _FACTORS).min(axis=0))
    keys = np.array([digest(least[BAND * k : BAND * (k + 1)].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes(), keys.tolist()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS) -> DataFrame:
    """One row of each group: that of the smallest id; of several rows of that id, or of null ids only, one of them.

    Two texts are linked if their wide fingerprints differ in at most as many bits as those of
    texts that share ``likeness`` of their words; a group is what links hold together. Rows are told apart by a
    number that is staged with them, so one id may have several texts, and the columns of the input
    may have any names. Null and empty texts are near copies of each other; an empty table stays empty.
    """
    at, of = docs.columns.index(id_col), docs.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(0)
        found = [sketch(t.as_py()) for t in rows.field(of).cast(pa.large_binary())]
        return pa.record_batch(
            [rows, rows.field(at), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["input", "id", "fp", "bands"]
        )

    schema = StructType([StructField("input", docs.schema), StructField("id", docs.schema[id_col].dataType), StructField("fp", BinaryType()), StructField("bands", ArrayType(LongType()))])
    numbered = staged(map_batches(packed(docs), each, schema).withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    distinct = numbered.groupBy("fp").agg(F.min(first).alias("first"), F.max("bands").alias("bands"))
    distinct = staged(distinct.select(F.col("first.row").alias("node"), "first", "fp", "bands"), "wide-fingerprints")
    keyed = distinct.select(F.posexplode("bands").alias("t", "k"), "node", "fp")
    edges = bucket_edges(keyed, [list(range(WIDE))], wide_radius(likeness), WIDE)
    roots = connected_components(edges).withColumnRenamed("node", "of")
    grouped = distinct.join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = staged(grouped.agg(F.min("first").alias("first")).select("first.row"), "kept-rows")
    left = numbered.select("row", "input").hint("merge").join(kept, "row", "left_semi")
    return left.select(*unpacked(left, docs.columns))
