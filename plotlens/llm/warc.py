"""WARC archives: write captures, read records back, and assemble transactions.

Each capture is written as a request, a response (or revisit) and a metadata record, tied together
by WARC-Concurrent-To. Every task writes its own gzip file (a member for each record) under a name
of its own in the shared folder and reports it in a manifest that Spark commits, so a retried or
doubled task leaves at most a file that no manifest names. Files are read as streams, a record at
a time. Transactions are assembled by joins on the concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows
from plotlens.session import shared_folder, staged

#: Bytes of payload in an Arrow batch of records, one record at least.
BATCH_BYTES = 8 << 20
#: Parts that the rows of one payload are dealt into when its response is looked up.
SALT = 32
#: The profile of a revisit, and the alphabet of base 32.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures carry this date unless the caller gives another: no clock is read.
DATE = "2024-01-01T00:00:00Z"


def _record_id(kind: str, page_id: int | None, url: str | None, digest: bytes) -> str:
    name = f"{kind}|{page_id}|{url}|".encode("utf-8", "surrogatepass") + digest
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"


def _record(kind: str, record_id: str, content_type: str, block: bytes, headers: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def _asked(uri: str | None) -> tuple[str, str]:
    """Host and path with query of a request for ``uri``; without ``://`` the host is empty. No form of it is an error."""
    _, mark, rest = (uri or "").partition("://")
    rest = rest.partition("#")[0] if mark else ""
    host = re.match(r"[^/?]*", rest)[0]
    path = rest[len(host) :]
    return host, path if path.startswith("/") else f"/{path}"


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_captures(captures: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write ``(page_id, url, payload, first_id, first_url)`` rows; return the staged manifest ``(path, records)``.

    A row whose ``(first_id, first_url)`` is its own ``(page_id, url)`` becomes a response, any
    other a revisit that refers to the response of that page.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _filesystem(folder)
        system.create_dir(at, recursive=True)
        context = TaskContext.get()
        path = f"{at}/part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n, out = 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out = system.open_output_stream(path, buffer_size=1 << 20, compression=None)
                page_id, url, payload, first_id, first_url = (c[i].as_py() for c in batch.columns)
                uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
                digest = hashlib.sha1(payload).digest()
                own = _record_id("response", page_id, url, digest)
                request = _record_id("request", page_id, url, digest)
                target = [("WARC-Date", date), ("WARC-Target-URI", uri)]
                digests = [("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}")]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                linked = [*target, ("WARC-Concurrent-To", request), *digests]
                if (first_id, first_url) == (page_id, url):
                    main = _record("response", own, "application/http;msgtype=response", head + payload, linked)
                else:
                    linked += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id("response", first_id, first_url, digest))]
                    main = _record("revisit", own, "application/http;msgtype=response", head, linked)
                host, wanted = _asked(uri)
                asks = f"GET {wanted} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
                out.write(_record("request", request, "application/http;msgtype=request", asks, target))
                out.write(main)
                fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
                about = [("WARC-Date", date), ("WARC-Concurrent-To", own)]
                out.write(_record("metadata", _record_id("metadata", page_id, url, digest), "application/warc-fields", fields, about))
                n += 3
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    rows = captures.select("page_id", "url", "payload", "first_id", "first_url")
    return staged(rows.mapInArrow(write, "path string, records bigint"), "warc-manifest")


def _headers(stream) -> list[tuple[str, str]]:
    found = []
    while (line := stream.readline().rstrip(b"\r\n")) or not found:
        if not line:
            return []
        key, _, value = line.decode("utf-8", "replace").partition(":")
        found.append((key.strip(), value.strip()))
    return found


def records_of(stream) -> Iterator[dict]:
    """The records of one decompressed archive; the payload is the block without HTTP headers."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = _headers(stream)
        first = dict(reversed(headers))
        block = stream.read(int(first.get("Content-Length", 0)))
        payload, length = block, None
        if first.get("Content-Type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            for field in head.split(b"\r\n")[1:]:
                key, _, value = field.partition(b":")
                if key.strip().lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
        yield {
            "type": first.get("WARC-Type"),
            "record_id": first.get("WARC-Record-ID"),
            "concurrent_to": [v for k, v in headers if k == "WARC-Concurrent-To"],
            "refers_to": first.get("WARC-Refers-To"),
            "target_uri": first.get("WARC-Target-URI"),
            "date": first.get("WARC-Date"),
            "digest": first.get("WARC-Payload-Digest"),
            "http_length": length,
            "payload": payload,
        }


RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, digest string, http_length bigint, payload binary"


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the files that the manifest's ``path`` column names, a file to a task."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.binary()]
    schema = pa.schema(list(zip([x.split()[0] for x in RECORD.split(", ")], kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    held, size = [], 0
                    for record in records_of(stream):
                        held.append(record)
                        size += len(record["payload"]) + 500
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """A nested row per capture: ``(main, requests, metadata)``.

    ``main`` is the response or revisit record. A request or metadata record belongs to it when
    one names the other in its concurrent-to, or when a metadata record names a request that
    belongs to it. Records repeated in full are one capture with ``copies`` above 1. A capture
    without requests or metadata has none; records that name no capture are left out; an empty
    table gives an empty result.
    """
    own = [c for c in records.columns if c not in ("type", "record_id")]
    record = F.struct("type", "record_id", *own)
    main = records.where("type in ('response', 'revisit')")
    side = records.where("type in ('request', 'metadata')").select("type", "record_id", record.alias("r"))
    named = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("root"))
    naming = records.where("type in ('request', 'metadata')").select("record_id", F.explode("concurrent_to").alias("to"))
    roots = main.select("record_id").distinct()
    direct = named.union(naming.join(roots.withColumnRenamed("record_id", "to"), "to").select("record_id", F.col("to").alias("root"))).distinct()
    second = naming.join(direct.withColumnRenamed("record_id", "to"), "to").select("record_id", "root")
    links = direct.union(second).distinct()
    of = side.join(links, "record_id").groupBy("root").agg(
        F.collect_set(F.when(F.col("type") == "request", F.col("r"))).alias("requests"),
        F.collect_set(F.when(F.col("type") == "metadata", F.col("r"))).alias("metadata"),
    )
    mains = main.groupBy("record_id").agg(F.first(record).alias("main"), F.count("*").alias("copies"))
    return mains.join(of, mains["record_id"] == of["root"], "left").select("main", "copies", "requests", "metadata")


def payload_digest(payload: Column) -> Column:
    """The bare upper-case base-32 SHA-1 of a binary column, natively: 40 hex digits in eight groups of 20 bits."""
    digits = F.sha1(payload)

    def letters(group: Column) -> Column:
        bits = F.conv(F.substr(digits, 5 * group + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(bits, 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in (3, 2, 1, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def captures_of(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, payload, first_id, first_url)``: the page whose record holds each page's payload.

    Pages of equal payloads of ``least_bytes`` at least share the one with the largest page_id
    (then url); smaller payloads are their own. Only digests are grouped; the pages meet the few
    groups of more than one page in a join salted by page, which spreads a hot payload.
    """
    rows = input_rows(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.select("page_id", F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    # nulls sort first, so a null page_id or url is smaller than any other
    first = F.max(F.struct(F.col("page_id").isNotNull(), F.col("page_id").alias("page_id"), F.col("url").isNotNull(), F.col("url").alias("url")))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.struct("first.page_id", "first.url").alias("first"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    own = F.struct("page_id", "url")
    return rows.join(groups, ["key", "salt"], "left").select(
        "page_id", "url", "payload", *[F.coalesce("first", own)[c].alias(f"first_{'id' if c == 'page_id' else c}") for c in ("page_id", "url")]
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages as WARC files, read them back and return a row per page.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, n_requests)``;
    a revisit's length is the one its HTTP headers give, its digest that of its header, and its
    ``refers_to`` comes from the response whose record it refers to. A null html is an empty
    payload; pages repeated in full give a row each; an empty table gives an empty result.
    """
    folder = folder or f"{shared_folder(spark).rstrip('/')}/plotlens-warc-{uuid.uuid4().hex}"
    manifest = write_captures(captures_of(pages, least_bytes), folder)
    records = read_records(manifest, folder)
    payload = F.col("payload")
    light = records.select(
        "type", "record_id", "concurrent_to", "refers_to", "target_uri",
        F.when(F.col("type") == "revisit", F.col("http_length")).otherwise(F.octet_length(payload)).alias("length"),
        F.when(F.col("type") == "revisit", F.substring_index("digest", ":", -1)).when(F.col("type") == "response", payload_digest(payload)).alias("digest"),
        F.when(F.col("type") == "metadata", F.regexp_extract(F.decode(payload, "UTF-8"), r"page-id: (-?\d+)", 1).try_cast("bigint")).alias("page_id"),
    )
    captures = staged(assemble(staged(light, "warc-records")), "warc-captures")
    captures = captures.select("main.*", "copies", F.element_at(F.col("metadata.page_id"), 1).alias("page"), F.size("requests").alias("n_requests"))
    responses = staged(captures.where("type = 'response'").select(F.col("record_id").alias("of"), F.col("page").alias("refers_page")), "warc-responses")
    revisits = captures.where("type = 'revisit'").hint("merge").join(responses, F.col("refers_to") == F.col("of"), "left")
    both = captures.where("type = 'response'").withColumn("refers_page", F.lit(None).cast("bigint"))
    both = both.unionByName(revisits.drop("of")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return both.select(
        F.col("page").alias("page_id"),
        F.col("length").cast("bigint").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
        "target_uri",
        "n_requests",
    )
