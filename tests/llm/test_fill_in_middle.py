"""The fill-in-middle transformation against plain slices, and the skip list against sums."""

import hashlib
import random
import re

import numpy as np

from plotlens.llm import fill_in_middle as fim


def test_skip_list_reaches_every_rank():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 17, 400, 3000):
        widths = np.array([r.randrange(1, 9) for _ in range(n)], np.int64)
        units, sums = fim.SkipList(widths), [0, *np.cumsum(widths).tolist()]
        assert all(units.seek(k) == (k, sums[k]) for k in (range(n + 1) if n < 500 else r.sample(range(n + 1), 300)))
        assert units.seek(n + 5) == (n, sums[n])
    assert [len(lane[0]) for lane in units.lanes] == sorted((len(lane[0]) for lane in units.lanes), reverse=True) and len(units.lanes) > 2


def test_against_plain_slices(spark):
    texts = [None, "", "x", "żółć 漢字 " * 30, "a <P> b", "a <S>", "<M>", "ends in <", "<" * 40, "P><S", "lines\r\n\t" * 50, "long " * 40_000]
    rows = [(100 * k + i, t, "x") for k in range(40) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (5, "same id"), (5, "same id")]
    docs = spark.createDataFrame([(r[0], r[1], "clash", 1) for r in rows], "doc_id bigint, text string, output string, n int")
    got = sorted(repr(tuple(r)) for r in fim.transformed(docs).collect())
    want, forms = [], set()
    for i, t in ((r[0], r[1] or "") for r in rows):
        h = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(repr((i, len(t), form, *((None, None) if form == "plain" else (a, b - a)), sha(out), sha(t))))
        forms.add(form)
    assert got == sorted(want) and forms == {"plain", "psm", "spm"}


def test_cuts_between_units(spark):
    text = "alpha beta, gamma  delta\nepsilon"
    rows = spark.createDataFrame([(i, text) for i in range(60)], "doc_id bigint, text string")
    bounds = {0, len(text), *(b for m in re.finditer(r"\w+", text) for b in m.span())}
    out = [r for r in fim.fill_in_middle(rows, unit=r"\w+").collect() if r.form != "plain"]
    assert len({r.prefix_chars for r in out}) > 4 and {r.n for r in out} == {len(bounds) - 1}
    assert all(r.prefix_chars in bounds and r.prefix_chars + r.middle_chars in bounds for r in out)


def test_no_documents(spark):
    assert fim.transformed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
