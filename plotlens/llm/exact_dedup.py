"""Exact dedup by a persistent digest index, bucketed and sorted by hash. DataFrame operations only.

Texts are equal when identical without the white space ``[\\x20\\x09-\\x0D]``; a null text
counts as empty. Of equal texts of a batch the one with the most code points in the original
text stays, then the smallest id; a null id is larger than any other. Rows repeated in full are
told apart by a row number that is given once, when the digests are staged. In a later batch of
an index that is kept, a text whose digest it holds already is a copy of the indexed row. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows, packed, unpacked, without_spaces
from plotlens.session import staged

#: Buckets of an index at least, and the digests that a bucket of a new one is meant for: about a GB.
BUCKETS, BUCKET_DIGESTS = 16, 16_000_000


def _numbered(rows: DataFrame, *more: str) -> DataFrame:
    """Rows ``(id, text)`` with ``row``, ``n`` and ``digest`` instead of the text."""
    return rows.select(
        *more,
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.coalesce(F.char_length("text"), F.lit(0)).alias("n"),
        F.unhex(F.sha2(without_spaces(F.col("text")), 256)).alias("digest"),
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n, digest)`` of every row, staged: about 60 bytes a document instead of its text."""
    return staged(_numbered(input_rows(docs, id=id_col, text=text_col)), "digests")


def _best(row: str, id_: str, n: str) -> Column:
    """The ``(row, id)`` of the row that stays: most code points, then smallest id, then smallest row."""
    return F.max_by(F.struct(F.col(row).alias("row"), F.col(id_).alias("id")), F.struct(F.col(n), F.col(id_).isNotNull(), -F.col(id_), -F.col(row)))


class DigestIndex:
    """A table ``(digest, row, id, n, copies)``, bucketed and sorted by digest, that only grows.

    ``add`` reads a batch once, keeps of each digest the best row of the batch, drops by a
    sort-merge anti-join what the index holds and appends the rest. Of the digests that were held
    already, the best row and the count of the batch go to a second table of the same form, so
    both tables together have the counts of all batches and the best row of each.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.later = f"{self.table}_later"

    def _append(self, rows: DataFrame, table: str) -> None:
        dealt = rows.select("digest", "row", "id", "n", "copies").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    def _later(self) -> DataFrame | None:
        return self.spark.table(self.later) if self.spark.catalog.tableExists(self.later) else None

    def _held(self) -> DataFrame:
        """``(digest, held_id, held)``: the indexed id of each digest and the copies of all batches so far."""
        held = self.spark.table(self.table).select("digest", F.col("id").alias("held_id"), F.col("copies").alias("held"))
        later = self._later()
        if later is None:
            return held
        more = later.groupBy("digest").agg(F.sum("copies").alias("more"))
        return held.join(more, "digest", "left").select("digest", "held_id", (F.col("held") + F.coalesce("more", F.lit(0))).alias("held"))

    def _update(self, rows: DataFrame) -> DataFrame:
        """Take up a batch; return ``(digest, row, id, n, copies, held_id, held)`` of its digests, staged."""
        best = rows.groupBy("digest").agg(_best("row", "id", "n").alias("best"), F.count("*").alias("copies"), F.max("n").alias("n"))
        best = staged(best.select("digest", "best.row", "best.id", "n", "copies"), "digest-groups")
        if not self.spark.catalog.tableExists(self.table):
            self._append(best, self.table)
            return best.select("*", F.lit(None).cast("bigint").alias("held_id"), F.lit(None).cast("bigint").alias("held"))
        fresh = staged(best.hint("merge").join(self.spark.table(self.table), "digest", "left_anti"), "digest-fresh")
        best = staged(best.join(self._held(), "digest", "left"), "digest-decisions")
        self._append(fresh, self.table)
        self._append(best.where(F.col("held").isNotNull()), self.later)
        return best

    def add(self, rows: DataFrame) -> DataFrame:
        """Add the ``digests`` of a batch; return ``(row, id, n, digest, keep_id, group_size, kept)``.

        What an earlier batch kept stays kept. The group is formed by a map-side combine, so a
        digest that a third of the rows share reaches the shuffle once for each task.
        ``group_size`` counts the rows of this batch and of all before it. The last join has a
        plain exchange on either side, so that AQE can split a hot digest.
        """
        of = self._update(rows).select(
            "digest",
            F.when(F.col("held").isNull(), F.col("row")).alias("keep_row"),
            F.when(F.col("held").isNull(), F.col("id")).otherwise(F.col("held_id")).alias("keep_id"),
            (F.col("copies") + F.coalesce("held", F.lit(0))).alias("group_size"),
        )
        return _decided(rows, of)

    def drop(self) -> None:
        """Delete the tables; what ``decide`` returned does not read them."""
        for table in (self.table, self.later):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def compact(self) -> None:
        """Write each table anew as one sorted file a bucket, after many appends; no bucket is shuffled, no answer changes."""
        for table in (self.table, self.later):
            if self.spark.catalog.tableExists(table):
                rows = self.spark.table(table)
                if table == self.later:
                    rows = rows.groupBy("digest").agg(_best("row", "id", "n").alias("best"), F.sum("copies").alias("copies"), F.max("n").alias("n")).select("digest", "best.row", "best.id", "n", "copies")
                fresh = f"{table}_{uuid.uuid4().hex}"
                self._append(rows, fresh)
                self.spark.sql(f"DROP TABLE {table}")
                self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")

    def add_all(self, batches: list[DataFrame]) -> None:
        """Add batches of one ``digests`` table, whose rows ``decide`` is asked for afterwards."""
        for batch in batches:
            self._update(batch)

    def decide(self, rows: DataFrame) -> DataFrame:
        """The columns of ``add`` for rows of all batches, by the best row of each digest in any batch.

        Row numbers must come from one ``digests`` table.
        """
        known = self.spark.table(self.table).select("digest", F.struct("n", "id", "row").alias("one"), "copies")
        later = self._later()
        if later is None:
            best, size = F.col("one"), F.col("copies")
        else:
            # both tables are dealt and sorted by digest already, so neither this grouping nor the join moves a row
            again = later.groupBy("digest").agg(_best("row", "id", "n").alias("b"), F.max("n").alias("n"), F.sum("copies").alias("more"))
            again = again.select("digest", F.struct("n", "b.id", "b.row").alias("other"), "more")
            known = known.hint("merge").join(again, "digest", "left")
            rank = lambda x: F.struct(x["n"], x["id"].isNotNull(), -x["id"], -x["row"])
            best = F.when(F.col("other").isNull() | (rank(F.col("one")) >= rank(F.col("other"))), F.col("one")).otherwise(F.col("other"))
            size = F.col("copies") + F.coalesce("more", F.lit(0))
        of = known.select("digest", best.alias("best"), size.alias("group_size"))
        of = staged(of.select("digest", F.col("best.row").alias("keep_row"), F.col("best.id").alias("keep_id"), "group_size"), "digest-winners")
        return _decided(rows, of)


def _decided(rows: DataFrame, of: DataFrame) -> DataFrame:
    return rows.hint("merge").join(of, "digest").select(
        "row", "id", "n", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
    )


def _decide_all(rows: DataFrame) -> DataFrame:
    """Decisions on all rows of one ``digests`` table by a new index that takes them up in two batches and is dropped."""
    index = DigestIndex(rows.sparkSession, buckets=max(BUCKETS, rows.count() // BUCKET_DIGESTS))
    index.add_all([rows.where(F.col("row") % 2 == b) for b in (0, 1)])
    out = index.decide(rows)
    index.drop()
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """A row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    With an ``index``, the documents are one more batch of it. Without, every other row goes to a
    new index first and the rest by anti-join afterwards, the index decides on all of them and is
    dropped. Null texts are empty ones, ties go to the smallest id, a null id is larger than any
    other, and an empty table gives an empty result.
    """
    rows = digests(docs, id_col, text_col)
    out = index.add(rows) if index else _decide_all(rows)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns, whatever they are called.

    Rows are staged with their numbers, by which the kept ones are told apart from rows repeated in
    full and from rows without an id; each text is shuffled once, by its row.
    """
    numbered = staged(_numbered(packed(docs, id=id_col, text=text_col), "input"), "numbered-documents")
    kept = _decide_all(numbered.select("row", "id", "n", "digest")).where("kept").select("row")
    kept = numbered.select("row", "input").hint("merge").join(staged(kept, "kept-rows"), "row", "left_semi")
    return kept.select(*unpacked(kept, docs.columns))
