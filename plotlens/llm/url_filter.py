"""URL filters: rules by host and path, and trust and distrust that spread over host edges. DataFrame operations only.

A rule such as ``example.com/en/`` fits its host, all subdomains and every path that starts with
its path; the longest that fits decides. Where none does, the host decides. The share of its pages
that rules allow is what a host is trusted for, the share they block what it is distrusted for.
Personalised PageRank carries trust along the links between hosts, and distrust against them: who
links to a blocked host is distrusted. A host counts as linking to the domain that it is in. A host is blocked if its distrust exceeds its trust and the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows
from plotlens.session import drop_staged, staged

#: The share of a host's score that its neighbours give; rounds at most, and the gain of one below which the scores stand.
DAMPING, ROUNDS, LEAST_GAIN = 0.85, 30, 1e-6
#: Distrust of a blocked host at least; a host whose pages are all blocked has 1 of its own.
THRESHOLD = 0.5
#: Rules up to which each is a condition of the plan; more are joined.
INLINE_RULES = 64
#: An address with a host in the ``href`` of a link.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rules = list[tuple[str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case, and the path behind it; both empty for a null url or one without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _inline(host: Column, path: Column, rules: Rules) -> Column:
    """The ``(size, block, rule)`` that decides on a url, from conditions of the plan."""
    found = []
    for rule, verdict in rules:
        own, start = _split(rule)
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict == "block").alias("block"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*found))


def ancestors(host: Column) -> Column:
    """The host and all domains that it is in, as an array from the longest name to the shortest; none for an empty one."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def _joined(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` with the deciding rule, by a join on each domain of the host and each start of the path that is as long as some rule's."""
    listed = [(*_split(rule), rule, verdict == "block") for rule, verdict in rules]
    table = rows.sparkSession.createDataFrame(listed, "own string, start string, rule string, block boolean")
    sizes = F.array(*[F.lit(n) for n in sorted({len(start) for _, start, _, _ in listed})])
    numbered = staged(rows.withColumn("row", F.monotonically_increasing_id()), "judged-urls")
    asked = numbered.select("row", "path", F.explode(ancestors(F.col("host"))).alias("own"))
    asked = asked.select("row", "own", F.explode(F.filter(sizes, lambda n: n <= F.length("path"))).alias("n"), "path").select("row", "own", F.substr("path", F.lit(1), F.col("n")).alias("start"))
    hit = asked.join(table, ["own", "start"]).groupBy("row").agg(F.max(F.struct(F.length("rule").alias("size"), "block", "rule")).alias("best"))
    return numbered.join(hit, "row", "left").drop("row")


def judged(pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, ruled)`` of every row: the longest rule that fits and its verdict, or nulls; of equal rules ``block`` wins."""
    rows = input_rows(pages, id=id_col, url=url_col)
    host, path = host_and_path(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    if len(rules) > INLINE_RULES:
        rows = _joined(rows, rules)
    else:
        rows = rows.withColumn("best", _inline(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<size:int,block:boolean,rule:string>"))
    return rows.select("id", "host", "path", "best.rule", F.when(F.col("best.block"), "block").when(~F.col("best.block"), "allow").alias("ruled"))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, n)``: how many links the pages of one host have to another. A null html has none."""
    rows = input_rows(pages, url=url_col, html=html_col)
    to = F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))
    links = rows.select(host_and_path(F.col("url"))[0].alias("src"), to.alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """``(src, dst, n)`` from each host to its domain, from that to the next one up, and so on to names of two labels; weight 1.

    So trust rises from a host to its domain and distrust falls from a domain to its hosts; hosts of one domain don't answer for each other.
    """
    names = F.filter(ancestors(F.col("host")), lambda d: F.contains(d, F.lit(".")))
    steps = F.arrays_zip(F.slice(names, 1, F.size(names) - 1).alias("src"), F.slice(names, 2, F.size(names)).alias("dst"))
    pairs = hosts.select("host").where("host like '%.%'").select(F.explode(steps).alias("s")).select("s.src", "s.dst")
    return pairs.distinct().select("src", "dst", F.lit(1).cast("bigint").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN) -> DataFrame:
    """``(host, trust, distrust)`` from ``seeds`` of the same columns over ``edges`` ``(src, dst, n)``.

    A score is the host's own seed and ``damping`` times what neighbours hand on, each by the share
    of its links (personalised PageRank, scaled to the seeds; what a host without links holds goes
    no further). A round is one join and one grouping with map-side sums; scores only grow, so the
    gain of a round is the difference of two totals, and these alone reach the driver. Hosts that
    nothing reaches are left out. Each round's scores are written, so a lost executor costs a round.
    """
    edges = staged(edges.groupBy("src", "dst").agg(F.sum("n").alias("n")), "host-edges")
    away = edges.groupBy(F.col("src").alias("of")).agg(F.sum("n").alias("all"))
    back = edges.groupBy(F.col("dst").alias("of")).agg(F.sum("n").alias("all"))
    none = F.lit(0.0)
    forward = edges.join(away, F.col("src") == F.col("of")).select(F.col("src").alias("at"), F.col("dst").alias("to"), (damping * F.col("n") / F.col("all")).alias("wt"), none.alias("wd"))
    reverse = edges.join(back, F.col("dst") == F.col("of")).select(F.col("dst").alias("at"), F.col("src").alias("to"), none.alias("wt"), (damping * F.col("n") / F.col("all")).alias("wd"))
    steps = staged(forward.union(reverse).groupBy("at", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")), "host-steps")
    seeds = staged(seeds.where("trust > 0 or distrust > 0").select("host", "trust", "distrust"), "host-seeds")
    scores, before = seeds, 0.0
    for _ in range(rounds):
        handed = steps.join(scores, F.col("at") == F.col("host")).select(F.col("to").alias("host"), (F.col("wt") * F.col("trust")).alias("trust"), (F.col("wd") * F.col("distrust")).alias("distrust"))
        after = staged(handed.union(seeds).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-scores")
        total = after.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 0.0
        if scores is not seeds:
            drop_staged(scores)
        scores, gain, before = after, total - before, total
        if gain <= least_gain * total:
            break
    drop_staged(edges, steps, seeds)
    return scores


def filter_urls(pages: DataFrame, rules: Rules, threshold: float = THRESHOLD, damping: float = DAMPING, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: ``(id, host, path, rule, verdict, trust, distrust)``.

    Where no rule fits, a host is blocked if its distrust is above its trust and at least
    ``threshold``; pages without a host, and hosts that nothing is known of, are allowed. Repeated
    rows and null ids give a row each and count as pages of their host; a null html has no links; an
    empty table gives an empty result. A hot host is counted map-side and meets its one score in a
    join that Spark broadcasts or splits.
    """
    rows = staged(judged(pages, rules, id_col, url_col), "judged-pages")
    share = lambda v: (F.count_if(F.col("ruled") == v) / F.count("*"))
    hosts = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = staged(hosts, "hosts")
    scores = spread(hosts, link_edges(pages, url_col, html_col).union(domain_edges(hosts)), damping)
    out = rows.join(scores, "host", "left")
    trust, distrust = (F.round(F.coalesce(c, F.lit(0.0)), 9) for c in ("trust", "distrust"))  # sums of another order may differ in the last digits
    verdict = F.coalesce("ruled", F.when((distrust > trust) & (distrust >= threshold), "block").otherwise("allow"))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


#: The rules of the registered query.
RULES: Rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def verdicts(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Host, path, rule and verdict of every page under ``RULES``."""
    return filter_urls(pages, RULES, id_col=id_col).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def rules_sql(rules: Rules) -> str:
    """The rules as rows of SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, (*_split(rule), rule, verdict)))})" for rule, verdict in rules)
