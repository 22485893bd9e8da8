"""Document fingerprints: SimHash and permuted block tables. DataFrame operations only.

The terms of a text are its pairs of neighbouring words, weighted by how often they occur. Each
term's 64-bit hash votes for or against every bit with its weight; a bit is set where the votes
for it prevail. The votes for bits j and j + 32 are summed in the two halves of one number, so a
text needs 32 sums, which run in generated code. To find all fingerprints within a radius, tables
for every choice of equal blocks hold each fingerprint under its bits of those blocks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows, word_array
from plotlens.session import drop_staged, staged

BITS = 64
#: Bits that may differ between near fingerprints, and the blocks that the tables choose from.
RADIUS, BLOCKS = 3, 5
#: Fingerprints in an array of a table's bucket, about; larger buckets have several arrays.
CHUNK = 256
_HALVES = 0x0000000100000001


def term_hashes(text: Column) -> Column:
    """The hashes of all pairs of neighbouring words, repeats included; of the word, if there is one only."""
    words = word_array(text)

    def pairs(found: Column) -> Column:
        n = F.size(found) - 1
        both = F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.when(n > 0, both).otherwise(F.transform(found, lambda w: F.xxhash64(w)))

    return F.element_at(F.transform(F.array(words), pairs), 1)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(*keys, fp)``: the fingerprint of each row's ``text``; 0 for a text without words. Keys are unique."""
    terms = rows.select(*keys, F.explode_outer(term_hashes(F.col(text))).alias("term"))
    votes = [F.sum(F.shiftright("term", j).bitwiseAND(F.lit(_HALVES))).alias(f"v{j}") for j in range(BITS // 2)]
    summed = terms.groupBy(*keys).agg(*votes, F.count("term").alias("n"))
    bits = []
    for j in range(BITS // 2):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{j}", 32)
        top = 1 << (j + 32)
        bits.append(F.when(2 * low > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)))
        bits.append(F.when(2 * high > F.col("n"), F.lit(top - (1 << 64) if j == 31 else top)).otherwise(F.lit(0)))
    fp = F.lit(0).cast("bigint")
    for bit in bits:
        fp = fp.bitwiseOR(bit.cast("bigint"))
    return summed.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the two texts' term weights as their fingerprints estimate it, 0 at least."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.pi() / BITS))


def _masks(radius: int, blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in map(sum, combinations(each, blocks - radius))]


def _met(queries: DataFrame, all_fps: DataFrame, radius: int, blocks: int, chunk: int) -> DataFrame:
    """``(q, found)``: rows for each distinct query with the other fingerprints within the radius and how often each occurs.

    Two fingerprints that differ in at most ``radius`` bits share all bits of at least
    ``blocks - radius`` blocks, so they meet in a table; they are found in the first one only.
    The fingerprints of a bucket stand in arrays of about ``chunk``, dealt by a hash, so a query
    meets a row for each array and the search runs within it: no pair becomes a row.
    """
    masks = _masks(radius, blocks)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)]))
    keyed = all_fps.groupBy("fp").agg(F.count("*").alias("n")).select("fp", "n", table.alias("bucket")).select("bucket.*", "fp", "n")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    sizes = staged(sizes.withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).drop("size"), "bucket-sizes")
    dealt = keyed.hint("merge").join(sizes, ["t", "k"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    arrays = staged(dealt.groupBy("t", "k", "chunk").agg(F.collect_list(F.struct("fp", "n")).alias("held")), "bucket-arrays")
    drop_staged(sizes)
    asked = queries.select("fp").distinct().select("fp", table.alias("bucket")).select("bucket.*", F.col("fp").alias("q"))
    earlier = F.array(*[F.lit(m) for m in masks])

    def near(x: Column) -> Column:
        differ = x["fp"].bitwiseXOR(F.col("q"))
        before = F.exists(F.slice(earlier, 1, F.col("t")), lambda m: differ.bitwiseAND(m) == 0)
        return (F.bit_count(differ) <= radius) & (differ != 0) & ~before

    return asked.hint("merge").join(arrays, ["t", "k"]).select("q", F.filter("held", near).alias("found"))


def find_near(queries: DataFrame, all_fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """``(fp, near)``: each distinct query with every other distinct fingerprint within the radius."""
    return _met(queries, all_fps, radius, blocks, chunk).select(F.col("q").alias("fp"), F.explode("found.fp").alias("near"))


def count_near(queries: DataFrame, all_fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """``(fp, n_near)`` of each distinct query: how many other rows of ``all_fps`` have a fingerprint within the radius.

    A query is itself a row of ``all_fps``; further rows of its fingerprint count.
    """
    found = _met(queries, all_fps, radius, blocks, chunk).select("q", F.aggregate("found.n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    found = staged(found.groupBy("q").agg(F.sum("n").alias("others")), "near-others")
    own = all_fps.groupBy("fp").agg(F.count("*").alias("own")).join(queries.select("fp").distinct(), "fp", "left_semi")
    return own.join(found, own["fp"] == found["q"], "left").select("fp", (F.col("own") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def next_documents(keys: DataFrame) -> DataFrame:
    """``(doc, h, next_doc, next_h)`` of unique keys: the next one by descending ``(doc, h)``, after the last the first.

    Keys are sorted by ranges; a row looks back within its range, and the first of a range takes
    the last key of the range before it, of which there is one for each range.
    """
    ranged = keys.repartitionByRange("doc", "h").withColumn("range", F.spark_partition_id())
    ranged = staged(ranged.select("doc", "h", "range"), "key-ranges")
    own = Window.partitionBy("range").orderBy("doc", "h")
    last = ranged.groupBy("range").agg(F.max(F.struct("doc", "h")).alias("last"))
    whole = Window.orderBy("range")  # a row for each range
    bounds = last.select("range", F.lag("last").over(whole).alias("before"), F.max("last").over(Window.partitionBy()).alias("highest"))
    back = ranged.withColumn("back", F.lag(F.struct("doc", "h")).over(own))
    joined = back.join(bounds, "range")
    return joined.select("doc", "h", F.coalesce("back", "before", "highest").alias("next")).select("doc", "h", F.col("next.doc").alias("next_doc"), F.col("next.h").alias("next_h"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 20) -> DataFrame:
    """A row per document with its fingerprint, that of its edited text, and their likenesses.

    Besides the columns of the contract, documents whose id is divisible by ``every`` have
    ``n_near``: how many other documents have a fingerprint within the radius. A null text
    counts as empty. Rows repeated in full are one document in the order and give equal results;
    rows of one id stand in the order of a hash of their texts; a null id is smaller than any
    other. A single document is its own next. An empty table gives an empty result.
    """
    rows = input_rows(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("id", F.coalesce(F.col("id").cast("bigint"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("h"), "text")
    light = staged(rows.select("id", "doc", "h", F.char_length("text").cast("bigint").alias("n_chars")), "document-keys")
    distinct = light.select("doc", "h", "n_chars").distinct()
    rows = rows.drop("id")
    after = staged(next_documents(distinct.select("doc", "h")), "next-documents")
    after = staged(after.join(distinct, ["doc", "h"]), "next-documents-sizes")

    apart = rows.repartition("doc", "h")
    asks = after.select(F.col("next_doc").alias("doc"), F.col("next_h").alias("h"), F.col("doc").alias("to_doc"), F.col("h").alias("to_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    heads = apart.dropDuplicates(["doc", "h"]).join(asks.hint("shuffle_hash"), ["doc", "h"])
    heads = heads.select(F.col("to_doc").alias("doc"), F.col("to_h").alias("h"), "take", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"))
    keep = F.char_length("text") - F.col("take")
    edited = apart.dropDuplicates(["doc", "h"]).join(heads.hint("shuffle_hash"), ["doc", "h"])
    edited = edited.select("doc", "h", "text", F.concat(F.substring(F.col("text"), F.lit(1), keep), F.col("head")).alias("edited"))
    both = edited.select("doc", "h", F.explode(F.array(F.struct(F.lit(0).alias("version"), "text"), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("v"))
    both = both.select("doc", "h", "v.version", "v.text", F.when(F.col("v.version") == 1, F.sha2(F.col("v.text").cast("binary"), 256)).alias("sha"))
    prints = fingerprints(both, ["doc", "h", "version", "sha"])
    pick = [F.max(F.when(F.col("version") == v, F.col("fp"))).alias(n) for v, n in ((0, "fp"), (1, "edited_fp"))]
    prints = staged(prints.groupBy("doc", "h").agg(*pick, F.max("sha").alias("edited_sha256")), "fingerprints")

    near = count_near(prints.where(F.col("doc") % every == 0), prints)
    of_next = prints.select(F.col("doc").alias("next_doc"), F.col("h").alias("next_h"), F.col("fp").alias("next_fp"))
    out = after.select("doc", "h", "next_doc", "next_h").join(prints, ["doc", "h"]).hint("merge").join(of_next, ["next_doc", "next_h"])
    near = staged(near, "near-counts")
    out = out.hint("merge").join(near, "fp", "left")  # by fingerprint: a null key for all that don't ask would be one task
    out = out.withColumn("n_near", F.when(F.col("doc") % every == 0, F.col("n_near")))
    out = staged(out.drop("next_doc", "next_h"), "document-fingerprints")
    text = lambda fp: F.lower(F.lpad(F.hex(fp), 16, "0"))
    return light.hint("merge").join(out, ["doc", "h"]).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )
