"""Language ID: script ranges narrow the candidates, Viterbi labels spans of mixed-language text.

Words are runs of letters. A word's candidates are the languages that use its script; its score
for each is the log-likelihood of its letter trigrams and four-grams, hashed into tables of a fixed
size. Viterbi over the words of a document pays a penalty for each switch of language. The language
with the most letters is the document's. Scoring and Viterbi run on arrays over all documents of a
batch at once: every step of Viterbi advances all documents that still have words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows, packed, parts, unpacked

#: Slots of each of the two n-gram tables of a language, of up to ``LANGUAGES`` languages.
SLOTS = 1 << 15
#: Labelled documents of each language that the model is fitted on, about; a documented bound.
TRAIN_DOCS = 5_000
#: Languages up to which each n-gram table has all its slots; beyond, the tables shrink so that the model, which every task holds, does not grow.
LANGUAGES = 512
#: The cost of a switch of language between two words, in nats.
SWITCH = 8.0
#: A language uses a script if that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: Letters scored at once, and word scores (words times languages) held at once.
LETTERS, CELLS = 1 << 18, 1 << 22
#: First and last code points of the scripts that are told apart; others are script 0.
SCRIPTS = (
    (0x0041, 0x024F), (0x1E00, 0x1EFF), (0x0370, 0x03FF), (0x1F00, 0x1FFF), (0x0400, 0x052F), (0x0530, 0x058F),
    (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0750, 0x077F), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0E00, 0x0E7F),
    (0x10A0, 0x10FF), (0x1100, 0x11FF), (0xAC00, 0xD7AF), (0x3040, 0x30FF), (0x4E00, 0x9FFF),
)
#: Which ranges above are one script.
SCRIPT_IDS = (1, 1, 2, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11, 11, 12, 12)


@lru_cache(1)
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case if it is a letter, else 0; and its script."""
    lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.int8)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            small = c.lower()
            lower[i] = ord(small) if len(small) == 1 else i
    for (lo, hi), s in zip(SCRIPTS, SCRIPT_IDS, strict=True):
        script[lo : hi + 1] = s
    return lower, script


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as lower-case letters with zeros between words and texts, and the place where each text starts."""
    joined = "\0".join([*("" if t is None else t for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(((0 if t is None else len(t)) + 1 for t in texts), np.int64, len(texts))
    return letter_table()[0][points], np.cumsum(sizes) - sizes


def slots_for(languages: int) -> int:
    """Slots of a table, a power of two, so that all tables together hold ``2 * SLOTS * LANGUAGES`` numbers at most, or 16 each."""
    return min(SLOTS, max(16, 1 << (SLOTS * LANGUAGES // max(1, languages)).bit_length() - 1))


def grams(c: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the trigram around and the four-gram up to and after each place of ``c``."""
    z = np.concatenate(([0, 0], c, [0])).astype(np.uint64)
    before2 = np.where(z[1:-2] == 0, np.uint64(0), z[:-3])
    mix = np.uint64(0x9E3779B97F4A7C15)
    h3 = ((z[1:-2] * np.uint64(0x1F123BB5) + z[2:-1]) * np.uint64(0x5851F42D) + z[3:]) * mix
    h4 = h3 + (before2 + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h4 = (h4 ^ (h4 >> np.uint64(29))) * mix
    shift = np.uint64(64 - slots.bit_length() + 1)
    return (h3 >> shift).astype(np.int64), (h4 >> shift).astype(np.int64)


def train(labelled: DataFrame, per_lang: int = TRAIN_DOCS) -> dict:
    """The model from ``(id, text, lang)``: languages, their n-gram tables and their scripts.

    Each language gives all its documents or, if it has more than ``per_lang``, those whose hash
    of the id falls under the share that makes about so many.
    """
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.count("*")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    slots = slots_for(len(langs))
    share = F.lit(1.0)  # only languages above the bound are named, so the expression does not grow with dirty labels
    if large := {lang: per_lang / n for lang, n in counts.items() if n > per_lang}:
        share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), F.col("lang")), share)
    place = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(place < share).select("lang", "text")
    index = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 2 * slots + 64), np.int64)
        for batch in batches:
            lang, text = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(text), 64):
                c, starts = letters_of(text[at : at + 64])
                of = np.repeat([index[x] for x in lang[at : at + 64]], np.diff(np.append(starts, len(c))))
                letters = np.flatnonzero(c)
                third, fourth = grams(c, slots)
                for slot in (third[letters], fourth[letters] + slots, letter_table()[1][c[letters]].astype(np.int64) + 2 * slots):
                    np.add.at(total, (of[letters], slot), 1)
        where = np.nonzero(total)
        yield pa.record_batch([pa.array(where[0]), pa.array(where[1]), pa.array(total[where])], names=["lang", "slot", "n"])

    table = sample.mapInArrow(count, "lang bigint, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(langs), 2 * slots + 64))
    total[table.column(0).to_numpy(), table.column(1).to_numpy()] = table.column(2).to_numpy()
    parts = []
    for lo in (0, slots):
        part = total[:, lo : lo + slots] + 0.1
        parts.append(np.log(part / part.sum(axis=1, keepdims=True)).T.astype(np.float32))
    scripts = total[:, 2 * slots :]
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "slots": slots, "third": parts[0], "fourth": parts[1], "uses": uses.T & (scripts.T > 0)}


def word_scores(c: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and scores (word, language) of the words in ``c``; a word's best score is 0."""
    is_letter = c != 0
    edge = np.diff(np.concatenate(([False], is_letter, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    scores = np.zeros((len(starts), len(model["langs"])), np.float32)
    lo = 0
    while lo < len(starts):  # in parts of so many letters, at word bounds
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + LETTERS)))
        a, b = starts[lo], ends[hi - 1]
        third, fourth = grams(np.concatenate(([0, 0], c[a:b], [0])), model["slots"])
        each = 0.5 * (model["third"][third[2:-1]] + model["fourth"][fourth[2:-1]])
        each[c[a:b] == 0] = 0
        scores[lo:hi] = np.add.reduceat(each, starts[lo:hi] - a, axis=0)
        lo = hi
    allowed = model["uses"][letter_table()[1][c[starts]]]
    scores[~allowed & allowed.any(axis=1, keepdims=True)] = -1e6
    scores[~allowed.any(axis=1)] = 0
    scores -= scores.max(axis=1, keepdims=True, initial=-np.inf) if len(starts) else 0
    return starts, ends - starts, np.maximum(scores, -30.0)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; document d has the words ``first[d] : first[d] + count[d]``."""
    order = np.argsort(-count, kind="stable")
    at, left = first[order], count[order]
    n_docs = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # that have a word t
    n_langs = scores.shape[1]
    came_from = np.zeros(scores.shape, np.int32)
    v = np.zeros((len(order), n_langs), np.float32)
    keep = np.arange(n_langs, dtype=np.int32)
    for t, n in enumerate(n_docs):
        rows = at[:n] + t
        if t:
            best = v[:n].argmax(axis=1)
            jump = v[np.arange(n), best] - switch
            stay = v[:n] >= jump[:, None]
            came_from[rows] = np.where(stay, keep, best[:, None])
            v[:n] = np.where(stay, v[:n], jump[:, None]) + scores[rows]
        else:
            v[:n] = scores[rows]
    label = np.zeros(len(scores), np.int32)
    now = v.argmax(axis=1)
    for t in range(len(n_docs) - 1, -1, -1):
        n = n_docs[t]
        rows = at[:n] + t
        label[rows] = now[:n]
        now[:n] = came_from[rows, now[:n]]
    return label


def label_texts(texts: list[str | None], model: dict) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language; code points) of each text."""
    c, places = letters_of(texts)
    langs = model["langs"]
    und = ("und", 0.0, [])
    if not langs or not len(c):
        return [und for _ in texts]
    starts, sizes, scores = word_scores(c, model)
    first = np.searchsorted(starts, places)
    count = np.diff(np.append(first, len(starts)))
    label = viterbi(scores, first, count)
    doc = np.repeat(np.arange(len(texts)), count)
    letters = np.zeros((len(texts), len(langs)), np.int64)
    np.add.at(letters, (doc, label), sizes)
    whole, best = letters.sum(axis=1), letters.argmax(axis=1)
    turn = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])))) if len(doc) else np.zeros(0, np.int64)
    last = np.append(turn[1:], len(doc)) - 1
    spans: list[list] = [[] for _ in texts]
    for a, b in zip(turn.tolist(), last.tolist(), strict=True):
        d = doc[a]
        spans[d].append((int(starts[a] - places[d]), int(starts[b] + sizes[b] - places[d]), langs[label[a]]))
    return [
        (langs[best[d]], float(letters[d, best[d]] / whole[d]), spans[d]) if whole[d] else und for d in range(len(texts))
    ]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, spans)`` of every row.

    ``score`` is the share of the letters that the spans of the language hold; ``spans`` lists
    ``lang:start:end`` in code points. A null text, one without letters, and any text under a
    model without languages is ``und`` with score 0.
    """
    rows = input_rows(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 4 * CELLS // max(1, len(held.value["langs"]))
        for batch in batches:
            for part in parts(batch, 1, most):
                found = label_texts(part.column(1).to_pylist(), held.value)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([",".join(f"{lang}:{a}:{b}" for a, b, lang in f[2]) for f in found], pa.string()),
                    ],
                    names=["id", "lang_pred", "score", "spans"],
                )

    return rows.mapInArrow(each, f"id {kind}, lang_pred string, score double, spans string")


def held_out(id_col: str = "doc_id"):
    """True for the third of the documents that no model learns from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: its id, ``held_out``, ``lang_pred``, ``score`` and ``spans``.

    Repeated rows give repeated results and an empty table an empty one; a label that is null is
    not learned from. However many labels there are, all are learned. Of languages with equally many letters the first by name is predicted. A very
    long text is labelled whole, alone in its part of a batch.
    """
    model = train(input_rows(docs.where(~held_out(id_col)), id=id_col, text=text_col, lang=lang_col))
    out = predict(docs, model, id_col, text_col)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "spans")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows whose text has a language that holds at least the share ``least`` of its letters.

    Each row is decided on by its own text where it is read, so nothing is shuffled but the n-gram
    counts, and one id may have several texts. Null texts and texts without letters go; an empty
    table stays empty.
    """
    model = train(input_rows(docs.where(~held_out(id_col)), id=id_col, text=text_col, lang=lang_col))
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 4 * CELLS // max(1, len(held.value["langs"]))
        for batch in batches:
            for part in parts(batch, 0, most, place):
                found = label_texts(part.column(0).field(place).to_pylist(), held.value)
                yield part.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found]))

    kept = packed(docs)
    kept = kept.mapInArrow(each, kept.schema)
    return kept.select(*unpacked(kept, docs.columns))
