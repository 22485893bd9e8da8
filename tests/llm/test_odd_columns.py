"""Columns of the input that are called like the operators' own, more labels than a model has full tables for, and near copies."""

import math
import random

import pytest

from plotlens.llm import exact_dedup, language_id, mixing, simhash_dedup

HELPERS = (
    "input", "id", "row", "n", "digest", "key", "kept", "place", "copy", "count", "of", "parts", "steps", "mean", "fp", "bands", "root", "first", "node",
    "__key", "__n", "__rank", "__row", "__fp", "__source", "__parts", "__count", "__copy", "__id", "a.b", "sp ace",
)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, " ".join(f"w{i % 7}x{k}" for k in range(30)), f"s{i % 2}", *[f"{h}-{i}" for h in HELPERS]) for i in range(20)]
    rows += [rows[3], (None, None, None, *[None] * len(HELPERS))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{h}` string" for h in HELPERS)), {tuple(r) for r in rows}


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash_dedup.keep_one_of_each])
def test_dedup_keeps_columns_and_values(odd, keep):
    docs, rows = odd
    out = keep(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= rows and sorted(repr(r[0]) for r in got) == sorted(["None", *map(repr, range(7))])


def test_language_keeps_columns_and_values(odd):
    docs, rows = odd
    out = language_id.keep_known(docs, lang_col="source")
    assert out.columns == docs.columns
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(repr(tuple(r)) for r in docs.collect() if r.text)


def test_mix_keeps_columns_and_values(odd):
    docs, rows = odd
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_"]
    got = [tuple(r) for r in out.collect()]
    assert {r[:-1] for r in got} <= rows and len({r[:-1] for r in got}) > 5 and min(r[-1] for r in got) == 1
    plain = mixing.mix(docs, copy_col=None)
    assert plain.columns == docs.columns and plain.count() == len(got)


def test_more_languages_than_full_tables(spark):
    rows = [(i, f"tekst numer {i} slowo{i % 5}", f"label{i}") for i in range(700)] + [(i, "the quick brown fox and the lazy dog", "en") for i in range(700, 760)]
    model = language_id.train(spark.createDataFrame(rows, "id bigint, text string, lang string"))
    assert len(model["langs"]) == 701 and model["third"].shape == (language_id.slots_for(701), 701) and language_id.slots_for(701) == language_id.SLOTS // 2
    assert language_id.slots_for(512) == language_id.SLOTS
    assert language_id.label_texts(["the quick brown fox and the lazy dog"], model)[0][0] == "en"


def test_near_copies_by_likeness(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, family = [], {}
    for f in range(60):
        base = [word() for _ in range(200)]
        for c in range(5):
            text = list(base)
            for at in r.sample(range(200), [0, 2, 5, 9, 80][c]):  # the last is another text
                text[at] = word()
            family[10 * f + c] = f if c < 4 else (f, c)
            rows.append((10 * f + c, " ".join(text)))
    kept = [x.doc_id for x in simhash_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert {i for i in kept if i % 10 == 4} == {i for i in family if i % 10 == 4}  # clean ones stay
    assert all(10 * f in kept for f in range(60))
    gone = sum(i % 10 in (1, 2, 3) for i in family) - sum(i % 10 in (1, 2, 3) for i in kept)
    assert gone >= 0.95 * 180


def test_wide_distance_is_the_angle():
    r = random.Random(1)
    for share in (0.3, 0.8, 0.95):
        a = [f"w{r.random()}" for _ in range(1000)]
        b = a[: int(1000 * share)] + [f"v{r.random()}" for _ in range(1000 - int(1000 * share))]
        x, y = (int.from_bytes(simhash_dedup.sketch(" ".join(t).encode())[0], "little") for t in (a, b))
        assert abs((x ^ y).bit_count() / 512 - math.acos(share) / math.pi) < 0.06


def test_a_large_group_is_compared_once(monkeypatch):
    calls = []
    near = simhash_dedup.near_lanes
    monkeypatch.setattr(simhash_dedup, "near_lanes", lambda *a: calls.append(1) or near(*a))
    values = [1 << (i % 60) | 1 << (i * 7 % 61) for i in range(500)]
    values = sorted(set(values))
    assert len({b for _, b in simhash_dedup._link(values, list(range(64)), None, 4)}) == 1 and len(calls) < 5


def test_compaction_changes_no_answer(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = exact_dedup.digests(spark.createDataFrame([(i, f"t{i % 9}" + " " * (i % 4)) for i in range(60)], "doc_id bigint, text string"))
    index.add_all([rows.where(f"row % 3 = {b}") for b in range(3)])
    plan = index.decide(rows)
    before = sorted(map(tuple, plan.select("id", "keep_id", "group_size", "kept").collect()))
    index.compact()
    assert sorted(map(tuple, index.decide(rows).select("id", "keep_id", "group_size", "kept").collect())) == before
    assert len(spark.table(index.table).inputFiles()) <= 4 and sum(k for *_, k in before) == 9
    index.drop()
