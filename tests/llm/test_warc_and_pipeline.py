"""WARC round trips, and the pipeline against a brute-force version."""

import base64
import hashlib
import re

import pytest

import corpus_pipeline
from plotlens.llm import queries, simhash_dedup, warc

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (3, "http://b.example/é\n?q=1", "<p>über</p>"),
    (4, None, None), (5, "http://c.example/", ""), (6, "d", "x" * 300_000), (6, "d", "x" * 300_000), (6, "e", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (None, "http://z.example", "<p>one</p>"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, type string")
    rows = warc.archive_round_trip(spark, pages).collect()
    first = {}
    for i, _, h in PAGES:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        body, own = (h or "").encode(), first[h or ""] == (-1 if i is None else i)
        want.append((repr(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first[h or ""]))
    assert sorted(map(repr, want)) == sorted(repr((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
    assert {r.n_requests for r in rows} == {1}


def test_nested_captures(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:3], "page_id bigint, url string, html string")
    manifest = warc.write_captures(warc.captures_of(pages), str(tmp_path))
    assert manifest.agg({"records": "sum"}).first()[0] == 9
    rows = warc.assemble(warc.read_records(manifest, str(tmp_path))).collect()
    assert len(rows) == 3
    by_type = {r.main.type: r for r in rows}
    assert bytes(by_type["response"].main.payload).startswith(b"<p>") and bytes(by_type["revisit"].main.payload) == b""
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 for r in rows)
    assert all(bytes(r.metadata[0].payload).startswith(b"page-id: ") for r in rows)


def test_addresses_of_any_form(spark):
    urls = ["http://[abc/x", "http://a]b/", "http://[zz]/", "http://", "://", "http://h?q", "http://h#f", "x y\x00\r\n"]
    rows = warc.archive_round_trip(spark, spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id bigint, url string, html string")).collect()
    assert {r.page_id for r in rows} == set(range(len(urls))) and {r.record_type for r in rows} == {"response"}
    assert [warc._asked(u) for u in ("http://[abc/x", "http://h?q", "h/p", None, "http://h#f")] == [("[abc", "/x"), ("h", "/?q"), ("", "/"), ("", "/"), ("h", "/")]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "page_id bigint, url string, html string")
    assert {r.record_type for r in warc.archive_round_trip(spark, pages, least_bytes=2).collect()} == {"response"}


def test_no_pages(spark):
    assert warc.archive_round_trip(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], sf_dir).cache())
        if name != "bpe":
            assert tables[-1].columns == docs.columns
    known, exact, near, mixed, coded = ([tuple(r) for r in t.collect()] for t in tables[1:])
    assert {r[0] for r in known} == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    best = {}
    for r in known:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    assert sorted(exact) == sorted(min(v, key=lambda r: (-len(r[1]), r[0])) for v in best.values())
    fp = {r[0]: int.from_bytes(simhash_dedup.sketch(r[1].encode())[0], "little") for r in exact}
    group = {i: i for i in fp}
    for _ in fp:
        moved = {i: min(group[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= simhash_dedup.wide_radius()) for i in fp}
        if moved == group:
            break
        group = moved
    assert len(set(group.values())) < len(group)
    assert sorted(near) == sorted(r for r in exact if group[r[0]] == r[0])
    assert set(mixed) <= set(near)
    assert sorted(r[0] for r in coded) == sorted(r[0] for r in mixed)
    text = {r[0]: r[1] for r in mixed}
    assert all(r[3] == hashlib.sha256(text[r[0]].encode()).hexdigest() for r in coded)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0
