"""Lyndon arrays and runs against plain definitions."""

import hashlib
import random
import zlib

import numpy as np

from plotlens.llm import runs


def test_lyndon_arrays():
    r = random.Random(3)
    for _ in range(1500):
        s = [r.randrange(r.choice((1, 2, 3, 5))) for _ in range(r.randrange(0, 30))]
        want = []
        for i in range(len(s)):
            j = i + 1
            while j < len(s) and s[j:] > s[i:]:
                j += 1
            want.append(j - i)
        assert runs.lyndon_array(s) == want


def plain_runs(s):
    out = []
    for p in range(1, len(s) // 4 + 1):
        i = 0
        while i < len(s) - p:
            j = i
            while j < len(s) - p and s[j] == s[j + p]:
                j += 1
            length = j - i + p
            if length >= max(6, 4 * p) and all(any(s[i + k] != s[i + k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def words_with_repeats(r, most):
    s = []
    while len(s) < most:
        b = [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randrange(1, 7))]
        s += b * r.choice((1, 1, 2, 3, 4, 5, 6)) + b[: r.randrange(len(b))]
    return s


def test_runs():
    r, n = random.Random(5), 0
    for _ in range(2000):
        s = words_with_repeats(r, r.randrange(0, 90))
        want = plain_runs(s)
        n += len(want)
        assert runs.runs_of(np.array(s, np.int64)) == want
    assert n > 1000


def test_documents(spark):
    r = random.Random(7)
    texts = [" ".join(f"w{x}" for x in words_with_repeats(r, r.randrange(0, 150))) for _ in range(150)]
    texts += [None, "", " \t\r\n", "the " * 50_000, "a b " * 30 + "\x1c" * 3, "é\u00a0é " * 9, " ".join(f"u{i % 3000}" for i in range(12_500))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y " * 9), (None, "x y " * 9), (1, texts[1]), (1, texts[1])]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id bigint, text string, runs string, n int")
    want, looped = [], 0
    for i, t in rows:
        w = (t or "").encode().split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, looped = h // 10, looped + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        ids = {}
        s = [ids.setdefault(x, len(ids)) for x in w]
        found = plain_runs(s) if len(s) < 10_000 else runs.runs_of(np.array(s, np.int64))
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        gone = {k for a, n, p in found for k in range(a + p, a + n)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(found), *first, sha("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert looped > 5
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in runs.periodic_runs(docs).collect())


def test_long_runs_by_hand():
    assert runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert runs.runs_of(np.array([9, *[i % 3000 for i in range(12_500)], 8], np.int64)) == [(1, 12_500, 3000)]
    assert runs.runs_of(np.array([i % 3000 for i in range(11_999)], np.int64)) == []


def test_no_documents(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
