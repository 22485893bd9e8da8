"""The digest index over several batches."""

from plotlens.llm import exact_dedup


def test_a_third_batch_counts_the_second(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    add = lambda rows: {r.id: (r.keep_id, r.group_size, r.kept) for r in index.add(exact_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert add([(1, "a b"), (2, "c")]) == {1: (1, 1, True), 2: (2, 1, True)}
    assert add([(3, "ab"), (4, "ab"), (5, "d")]) == {3: (1, 3, False), 4: (1, 3, False), 5: (5, 1, True)}
    assert add([(6, "ab"), (7, "d")]) == {6: (1, 4, False), 7: (5, 2, False)}


def test_the_query_reaches_the_anti_join(spark, monkeypatch):
    seen = []
    update = exact_dedup.DigestIndex._update

    def counted(self, rows):
        held = self.spark.table(self.table).count() if self.spark.catalog.tableExists(self.table) else 0
        seen.append((held, rows.count()))
        return update(self, rows)

    monkeypatch.setattr(exact_dedup.DigestIndex, "_update", counted)
    rows = [(9, "a"), (1, "a"), (8, "a "), (2, "b"), (None, "b"), (5, "b"), (3, "c"), (4, "a"), (4, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(seen) == 2 and seen[1][0] > 0 and sum(n for _, n in seen) == len(rows)
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in out) == [
        (0, 2, 3, False), (1, 8, 5, False), (2, 2, 3, True), (3, 3, 1, True), (4, 8, 5, False), (4, 8, 5, False), (5, 2, 3, False), (8, 8, 5, True), (9, 8, 5, False),
    ]
