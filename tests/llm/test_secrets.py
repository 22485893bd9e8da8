"""Ownership and whole values of secrets."""

import time

import pytest

from plotlens.llm import secrets

TOKEN = "ghp_Zq9Xw8Ce7Rv6Tb5Yn4Um3Ik2Ol1Pa0Ss9Dd8"


def test_one_owner_stays_live_in_many_documents(spark):
    rows = [(i, f"use {TOKEN} now", "one") for i in range(30)]
    rows += [(100 + i, f"use {TOKEN[::-1].replace('_phg', '')} ghp_{TOKEN[:3:-1]} now", f"owner{i % 3}") for i in range(30)]
    out = {r.doc_id: r for r in secrets.summary(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all((out[i].spans, out[i].n_live) == ("provider:4:44", 1) for i in range(30))
    assert all(out[100 + i].spans == "" for i in range(30))


@pytest.mark.parametrize(
    ("kind", "before", "value", "after"),
    [
        ("jwt", "a-", "eyJ" + "hA" * 4000 + ".eyJ" + "pB" * 4000 + "." + "sC" * 4000, " x"),
        ("provider", "use ", "sk-" + "aB3" * 200, " x"),
        ("provider", "use ", "xoxb-" + "aB-3" * 200, " x"),
        ("pem", "", "-----BEGIN PRIVATE KEY-----" + "aB3+" * 5000, "-----END PRIVATE KEY-----"),
        ("url", "https://" + "u" * 100 + ":", "pA5" * 100, "@host"),
    ],
)
def test_long_values_are_whole(kind, before, value, after):
    found = [s for s in secrets.candidates(before + value + after) if s[0] == kind]
    assert found == [(kind, len(before), len(before) + len(value), False, value)]


def test_search_stays_linear():
    start = time.monotonic()
    for text in ("-eyJaaaaaaaa" * 20_000, "eyJaaaaaaaa." * 20_000, "xoxb-" * 40_000, "-----BEGIN " * 20_000, "a://" + "u" * 200_000, "a://u:" * 30_000):
        secrets.candidates(text)
    assert time.monotonic() - start < 10
