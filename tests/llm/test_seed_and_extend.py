"""Substring dedup on mosaics of passages, against brute force."""

import random

import numpy as np
import pytest

from plotlens.llm import substring_dedup


def brute(docs, window):
    first = {}
    for i, t in docs:
        w = t.split()
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = t.split()
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = True
        out.append((i, len(w), int(gone.sum())))
    return sorted(out)


@pytest.mark.parametrize(("seed", "window", "alphabet"), [(1, 12, 3), (2, 14, 40), (3, 50, 2), (4, 50, 500)])
def test_mosaics(spark, seed, window, alphabet):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(alphabet)}"
    passages = [[word() for _ in range(rng.randrange(window // 2, 2 * window))] for _ in range(12)]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            cut = rng.choice(passages)
            a = rng.randrange(len(cut) // 3 + 1)
            parts += cut[a : len(cut) - rng.randrange(len(cut) // 3 + 1)] + [word() for _ in range(rng.choice((0, 0, 1, 5)))]
        docs.append((rng.choice((i, i, max(0, i - 1))), " ".join(parts)))
    docs += [(90, "a " * 130), (91, "a " * 70 + "b " + "a " * 70), (92, "a b " * 60), (93, "b a " * 60)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), window=window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == brute(docs, window)
    assert any(r.n_removed for r in got)


def test_a_third_class_covers_what_the_leader_does_not(spark):
    """Three documents hold one anchor; the last one's windows start in the second, not in the first."""
    rng = random.Random(9)
    core = [f"c{i}" for i in range(20)]
    tail = [f"t{i}" for i in range(60)]
    one = [f"x{rng.random()}" for _ in range(60)] + core + [f"y{i}" for i in range(60)]
    docs = [(1, " ".join(one)), (2, " ".join([f"p{i}" for i in range(50)] + core + tail)), (3, " ".join([f"q{i}" for i in range(50)] + core + tail))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 80}
    assert [list(x.asDict().values()) for r in got if r.doc_id == 3 for x in r.repeats] == [[50, 130]]


def test_extend():
    a, b = np.array([1, 2, 3, 4, 5, 6], np.uint64), np.array([9, 3, 4, 5, 7], np.uint64)
    assert substring_dedup.extend(a, 3, b, 2) == (2, 5)
    assert substring_dedup.extend(a, 3, a, 3) == (0, 6)
