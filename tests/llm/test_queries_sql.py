"""Registered document queries against their SQL, op8 against a plain Viterbi, and the pipeline on odd tables."""

import math
import unicodedata

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from plotlens.llm import language_id, queries

TABLES = ("documents", "pages")


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    df, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in places]) for r in want.fetchall())


def plain_viterbi(text, model):
    """One word and one language at a time: the language of the text and its share of the letters."""
    words, word = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] == "L":
            small = c.lower()
            word += small if len(small) == 1 else c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    langs, script_of = model["langs"], language_id.letter_table()[1]
    v, back = None, []
    for w in words:
        third, fourth = language_id.grams(np.array([0, 0, *map(ord, w), 0], np.uint32))
        each = 0.5 * (model["third"][third[2:-1]] + model["fourth"][fourth[2:-1]])
        score = each.sum(axis=0)
        allowed = model["uses"][script_of[ord(w[0])]]
        score = np.where(allowed, score, -1e6) if allowed.any() else np.zeros(len(langs))
        score = np.maximum(score - score.max(), -30)
        if v is None:
            v = score
            continue
        best = int(v.argmax())
        step = [(j if v[j] >= v[best] - language_id.SWITCH else best) for j in range(len(langs))]
        back.append(step)
        v = np.array([v[j] if step[j] == j else v[best] - language_id.SWITCH for j in range(len(langs))]) + score
    at = int(v.argmax())
    labels = [at]
    for step in reversed(back):
        at = step[at]
        labels.append(at)
    letters = np.zeros(len(langs))
    for w, label in zip(words, reversed(labels), strict=True):
        letters[label] += len(w)
    return langs[int(letters.argmax())], float(letters.max() / letters.sum())


def test_language_id_against_a_plain_viterbi(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    model = language_id.train(docs.where(~language_id.held_out()).selectExpr("doc_id AS id", "text", "lang"))
    rows = docs.select("doc_id", "text", "lang").collect()
    same = right = held = 0
    for r in rows:
        lang, score = plain_viterbi(r.text or "", model)
        same += got[r.doc_id].lang_pred == lang and math.isclose(got[r.doc_id].score, score, abs_tol=0.01)
        if got[r.doc_id].held_out and r.lang and lang != "und":
            held, right = held + 1, right + (got[r.doc_id].lang_pred == r.lang)
    assert same >= 0.99 * len(rows)  # sums of floats in another order may tip a tie
    assert held > 50 and right >= 0.95 * held


def test_language_id_on_long_texts_and_ties(spark):
    en, de = "the quick brown fox and the lazy dog ", "der schnelle braune fuchs und der faule hund "
    rows = [(3 * i + k, t, lang) for i in range(40) for k, (t, lang) in enumerate(((en, "en"), (de, "de"), (None, "en")))]
    rows += [(1000, en * 20_000, None), (1001, "", None), (1002, "123", None), (1003, "漢字", None)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert (out[1000].lang_pred, out[1000].score) == ("en", 1.0)
    assert {out[i].lang_pred for i in (1001, 1002)} == {"und"}
    assert out[1003].lang_pred == "de"  # no language uses the script: all words tie, the first by name is taken


def test_pipeline_on_odd_rows(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs through the dark forest "
    other = "some wholly different words follow here about ships and harbours in the north "
    rows = [(i, f"{text} {i} {other * (i % 5)}", "en", f"s{i % 2}", 10, "x") for i in range(40)]
    rows += [(1, None, "en", "s0", None, None), (None, text + "null id", "en", None, 5, "y"), (7, other * 3, None, "s1", 3, "z"), (7, other * 3, None, "s1", 3, "z"), (50, "", "en", "s0", 0, None)]
    rows += [(100 + i, " ".join(f"wort{chr(97 + i)}{chr(97 + k)}" for k in range(26)), "de", f"s{i % 2}", 10, None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __key string")
    for name, part in (("odd", docs), ("none", docs.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        seen = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            after = f(spark, seen, str(tmp_path / name))
            assert after.columns == docs.columns, stage
            assert after.count() <= max(seen.count() * 3, 1)
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(out) > 0) == (name == "odd")
        assert all(r.n_tokens > 0 for r in out)
