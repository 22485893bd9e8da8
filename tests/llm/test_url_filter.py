"""Rules against a plain reading of them, and scores against matrix powers."""

import numpy as np
import pytest

from plotlens.llm import url_filter as uf


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [k for k, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: ends[0]])
    behind = rest[ends[0] :]
    path = behind[: min([k for k, c in enumerate(behind) if c in "?#"] + [len(behind)])]
    best = None
    for rule, verdict in rules:
        own, start = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == own or host.endswith("." + own)) and path.startswith(start) and (best is None or (len(rule), verdict == "block") > (len(best[0]), best[1] == "block")):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


URLS = [
    "https://WWW.Example.com/en/1", "http://example.com/en/", "http://example.com", "http://a.example.com/en?x=/en/", "x://net/es/1#t", "http://b.net/fr/", "http://b.net/FR/", "http://planet/es/", "http://exampleXcom/en/",
    "http://u:p@h.com:80/a/b/c?d", "://com/", "http:///en/", "http://ÄB.com/é", "nourl", "", None, "a\nb://c.com/\nx?y", "http://x.org/a://b.com/", "http://com/#", "http://com?q",
]


@pytest.mark.parametrize("inline", [64, 0])
def test_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(uf, "INLINE_RULES", inline)
    rules = [*uf.RULES, ("com/a/", "block"), ("com/a/b", "allow"), ("net/es/", "allow"), ("x.org/a://", "block")]
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    pages = spark.createDataFrame([(i, u, None, "c") for i, u in rows], "page_id bigint, url string, html string, host string")
    got = sorted(repr(tuple(r)) for r in uf.judged(pages, rules).collect())
    assert got == sorted(repr((i, *plain(u, rules))) for i, u in rows)


def test_scores_against_a_dense_matrix(spark):
    rng = np.random.default_rng(4)
    hosts = [f"h{i}" for i in range(40)]
    links = {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, 30, 200), rng.integers(0, 40, 200), rng.integers(1, 9, 200), strict=True) if a != b}
    links |= {(0, j): 50 for j in range(1, 40)}  # a hub
    trust, distrust = rng.random(40) * (rng.random(40) < 0.2), rng.random(40) * (rng.random(40) < 0.2)
    m = np.zeros((40, 40))
    for (a, b), n in links.items():
        m[a, b] = n
    out = np.divide(m, m.sum(1, keepdims=True), where=m.sum(1, keepdims=True) > 0, out=np.zeros_like(m))
    back = np.divide(m, m.sum(0, keepdims=True), where=m.sum(0, keepdims=True) > 0, out=np.zeros_like(m))
    x, y = trust.copy(), distrust.copy()
    for _ in range(200):
        x, y = trust + 0.85 * out.T @ x, distrust + 0.85 * back @ y
    seeds = spark.createDataFrame([(h, float(t), float(d)) for h, t, d in zip(hosts, trust, distrust, strict=True)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([(hosts[a], hosts[b], n) for (a, b), n in links.items()], "src string, dst string, n bigint")
    got = {r.host: (r.trust, r.distrust) for r in uf.spread(seeds, edges, rounds=60).collect()}
    for i, h in enumerate(hosts):
        assert got.get(h, (0.0, 0.0)) == pytest.approx((x[i], y[i]), rel=1e-3, abs=1e-4)


def test_verdicts_spread_over_links(spark):
    a = lambda *to: " ".join(f'<a class=x href="{t}">l</a>' for t in to)
    pages = [
        (1, "http://bad.test/ads/1", None), (2, "http://bad.test/other", "<a href=/x>own</a>"), (3, "http://links-to-bad.test/", a("https://BAD.test/ads/", "//bad.test/")), (4, "http://good.test/ok/1", a("http://friend.test/")),
        (5, "http://friend.test/", a("/local", "mailto:x@bad.test")), (6, "http://both.test/", a("http://bad.test/")), (7, "http://good.test/ok/2", a("http://both.test/")), (8, "http://alone.test/", ""), (9, None, a("http://bad.test/")), (8, "http://alone.test/", ""),
        (None, "http://sub.bad.test/", None),
    ]
    rules = [("bad.test/ads/", "block"), ("good.test/ok/", "allow")]
    rows = uf.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), rules, threshold=0.1).collect()  # a fourth of 0.85 of half its pages reaches each who links to bad.test once
    got = sorted((r.id or 0, r.verdict) for r in rows)
    assert got == [(0, "block"), (1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (8, "allow"), (9, "allow")]


def test_no_pages(spark):
    assert uf.verdicts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
