"""Secret scans with corpus-wide ownership frequency.

Candidates of every text are the base spans (assignments, access keys, long hex strings) and
provider tokens, JSON web tokens, private keys and passwords in URLs. The hash of each candidate's
value is counted over distinct repositories and owners of the whole corpus: a value that many owners
hold is a copied example, one that a single owner holds and that looks random is taken for live, in
however many repositories it occurs.
Base spans always stay; of the others those are added that look live.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows
from plotlens.session import staged

KINDS = ("assign", "access", "hex")
#: Owners from which on a value counts as widely copied.
COPIED_OWNERS = 3
#: Bits of entropy a character from which on a value looks random.
RANDOM_BITS = 2.5
#: Parts of values that are placeholders.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "xxxx", "1234567", "password", "dummy", "sample")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: No value has a longest length, so all of it is hashed; possessive repeats of disjoint classes keep the search linear.
#: A web token starts at the first ``eyJ`` of its run that follows a hyphen or begins the run.
_OTHERS = (
    ("provider", re.compile(r"(?<![A-Za-z0-9_])((?:gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9]{20,}+))", re.A), ("gh", "xox", "sk-")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])(?>(?:[A-Za-z0-9_-]*?-)??(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+)", re.A), ("eyJ",)),
    ("pem", re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+)", re.A), ("-----BEGIN ",)),
    ("url", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]++:([^\s:/@]{6,}+)@", re.A), ("://",)),
)


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """``(kind, start, end, base, value)`` of a text, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span(), True, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), True, m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), True, m[0]) for m in _HEX.finditer(text)]
    for kind, pattern, hints in _OTHERS:
        if any(h in text for h in hints):
            out += [(kind, *m.span(1), False, m[1]) for m in pattern.finditer(text)]
    rank = {k: i for i, k in enumerate((*KINDS, *(o[0] for o in _OTHERS)))}
    out.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
    return out


def looks_random(value: str) -> bool:
    """Not a placeholder, and of enough entropy a character."""
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= RANDOM_BITS


def find_candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """``(row, id, owner, repo, found)`` of every row; only hashes of the values leave the tasks."""
    rows = input_rows(docs, id=id_col, owner=owner_col, repo=repo_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", F.col("owner").cast("string"), F.col("repo").cast("string"), "text")
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("hash", pa.int64()), ("random", pa.bool_())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(3):
                found.append([
                    {"kind": k, "start": a, "end": b, "base": base, "hash": xxhash.xxh64_intdigest(v.encode()) - 2**63, "random": looks_random(v)}
                    for k, a, b, base, v in candidates(value.as_py() or "")
                ])
            yield pa.record_batch([*batch.columns[:3], pa.array(found, pa.list_(pa.struct(fields)))], names=["id", "owner", "repo", "found"])

    spans = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,hash:bigint,random:boolean>>"
    found = rows.mapInArrow(each, f"id {kind}, owner string, repo string, found {spans}")
    return staged(found.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, owners, repos, class)``: distinct owners and (owner, repository) pairs that hold a value.

    Each step combines in the map tasks first, so a value that a third of the rows hold sends one
    row for each task. A null owner is an owner of its own.
    """
    held = found.select("owner", "repo", F.explode("found").alias("s")).select("s.hash", "s.random", "owner", "repo")
    pairs = held.groupBy("hash", "random", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "random", "owner").agg(F.sum("one").alias("repos"))
    values = owners.groupBy("hash", "random").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    copied = (F.col("owners") >= COPIED_OWNERS) | ~F.col("random")
    return values.select("hash", "owners", "repos", F.when(copied, "example").otherwise(F.when(F.col("owners") == 1, "live").otherwise("shared")).alias("class"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``(id, spans)`` of every row: its spans by start and kind, each with its class, owners and repositories.

    A null text counts as empty; repeated rows give repeated results; an empty table an empty one.
    Spans of one start stand in the order of their kinds; a null owner is an owner of its own.
    """
    found = find_candidates(docs, id_col, text_col, owner_col, repo_col)
    classes = staged(ownership(found), "secret-classes")
    spans = found.select("row", F.posexplode("found").alias("place", "s")).select("row", "place", "s.*")
    spans = spans.hint("merge").join(classes, "hash").where("base or class = 'live'")
    item = F.struct("place", "kind", "start", "end", "base", "class", "owners", "repos")
    of = spans.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    return found.select("row", "id").join(of, "row", "left").select("id", F.coalesce("spans", F.array().cast(of.schema["spans"].dataType)).alias("spans"))


def how_many(field: str, value: str, only_base: bool = False) -> Column:
    """The number of spans whose ``field`` is ``value``."""
    return F.size(F.filter("spans", lambda s: (s[field] == value) & (s["base"] | (not only_base)))).cast("bigint")


def joined(spans, only_base: bool = False):
    """``kind:start:end`` of the spans, comma-joined."""
    if only_base:
        spans = F.filter(spans, lambda s: s["base"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """A row per document: its id, base counts, ``base_sha256``, ``spans``, and how many look live or are copied examples."""
    out = find_secrets(docs, id_col, text_col, owner_col, repo_col)
    counts = [how_many("kind", k).alias(f"n_{k}") for k in KINDS]
    by_class = [how_many("class", c).alias(f"n_{c}") for c in ("live", "example")]
    return out.select(
        F.col("id").alias(id_col), *counts, F.sha2(joined("spans", True).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), *by_class
    )
