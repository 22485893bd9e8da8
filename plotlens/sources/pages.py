"""Offers embedded in web pages as JSON-LD, and admissible urls by robots rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def _offers(node, found: list) -> None:
    """All nodes of type Offer, at any depth."""
    if isinstance(node, dict):
        kinds = node.get("@type")
        if "Offer" in (kinds if isinstance(kinds, list) else [kinds]):
            found.append(node)
        for value in node.values():
            _offers(value, found)
    elif isinstance(node, list):
        for value in node:
            _offers(value, found)


def embedded_offers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, url, name, price, currency)`` of each offer of a page, once for each url.

    Blocks are cut out natively; only pages that have one reach Python, where each block is parsed.
    A block that is no JSON is left out.
    """
    blocks = pages.select(F.col(id_col).alias("page_id"), F.explode(F.regexp_extract_all(html_col, F.lit(BLOCK), F.lit(1))).alias("block"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = json.loads(block)
                except ValueError:
                    continue
                found: list = []
                _offers(tree, found)
                for o in found:
                    item = o.get("itemOffered") if isinstance(o.get("itemOffered"), dict) else {}
                    out.append({"page_id": page_id, "url": o.get("url") or item.get("url"), "name": o.get("name") or item.get("name"), "price": None if o.get("price") is None else str(o["price"]), "currency": o.get("priceCurrency")})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "name", "price", "currency"))]))

    return blocks.mapInArrow(parse, "page_id bigint, url string, name string, price string, currency string").dropDuplicates(["page_id", "url"])


def robots_rules(lines: DataFrame) -> DataFrame:
    """``(site, agent, allow, pattern, length)`` of robots lines ``(site, line_no, line)``; groups of one agent merge.

    A pattern's ``*`` is any text and ``$`` its end; the pattern becomes a regular expression.
    """
    clean = F.trim(F.regexp_replace("line", "#.*", ""))
    parts = lines.select("site", "line_no", F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("key"), F.trim(F.substring(clean, F.instr(clean, ":") + 1, F.length(clean))).alias("value"))
    order = Window.partitionBy("site").orderBy("line_no")
    starts = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(True))
    grouped = parts.where("key in ('user-agent', 'allow', 'disallow')").withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where("key = 'user-agent'").select("site", "group", F.lower("value").alias("agent"))
    rules = grouped.where("key in ('allow', 'disallow') and value <> ''").select("site", "group", (F.col("key") == "allow").alias("allow"), "value")
    escaped = F.regexp_replace("value", r"([.+?^(){}|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")))
    return rules.join(agents, ["site", "group"]).select("site", "agent", "allow", pattern.alias("pattern"), F.length("value").alias("length"))


def admissible(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``(site, path, allowed)``: the longest pattern that fits decides, allow on a tie; without one a path is allowed.

    The agent's own group counts where a site has one, else that of ``*``.
    """
    named = rules.where(F.col("agent") == agent.lower())
    general = rules.where("agent = '*'").join(named.select("site").distinct(), "site", "left_anti")
    hits = urls.distinct().join(named.union(general), "site").where(F.expr("rlike(path, pattern)"))
    best = hits.groupBy("site", "path").agg(F.max_by("allow", F.struct("length", "allow")).alias("allowed"))
    return urls.join(best, ["site", "path"], "left").select("site", "path", F.coalesce("allowed", F.lit(True)).alias("allowed"))
