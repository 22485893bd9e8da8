"""What weak supervision adds to the base spans: precision and recall on planted texts."""

import random

from plotlens.llm import pii

rng = random.Random(3)
FILL = "the quick brown fox jumps over a lazy dog while some more plain words stand around here".split()


def pad():
    return " ".join(rng.choice(FILL) for _ in range(14))


def digits(n):
    return "".join(rng.choice("123456789") for _ in range(n))


def corpus():
    """``(text, wanted)``: base spans teach the labelers; looser ones with telling words are wanted, decoys are not."""
    out = []
    for i in range(400):
        phone, mail = f"+1 {digits(3)} {digits(3)} {digits(4)}", f"u{i}@mail{i % 9}.com"
        out.append((f"{pad()} call {phone} {pad()}", None))
        out.append((f"{pad()} write to {mail} {pad()}", None))
        out.append((f"{pad()} version +{digits(16)} {pad()}", None))  # a failing match of the phone pattern
        if i % 4 == 0:
            spot = f"{digits(3)}-{digits(3)}-{digits(4)}"
            out.append((f"{pad()} my phone {spot} {pad()}", ("phone", spot)))
            spot = f"u{i} (at) mail{i % 9} (dot) com"
            out.append((f"{pad()} contact {spot} {pad()}", ("email", spot)))
            out.append((f"{pad()} order no {digits(3)}-{digits(3)}-{digits(4)} {pad()}", ("phone", "")))
            out.append((f"{pad()} serial {digits(3)}-{digits(3)}-{digits(4)} {pad()}", ("phone", "")))
            out.append((f"{pad()} u{i} (at) box (dot) invalid {pad()}", ("email", "")))
    return out


def test_added_spans(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    found = {r.id: [s for s in r.spans if not s.base] for r in pii.find_pii(rows).collect()}
    hits = missed = false = 0
    for i, (text, wanted) in enumerate(texts):
        got = {(s.kind, text[s.start : s.end]) for s in found[i]}
        true = {wanted} if wanted and wanted[1] else set()
        hits, missed, false = hits + len(got & true), missed + len(true - got), false + len(got - true)
    assert hits / (hits + missed) >= 0.9 and hits / max(1, hits + false) >= 0.9


def test_labelers_abstain():
    assert pii._gazetteer("email", "a@b.info") == 1 and pii._gazetteer("email", "a@b.zz9plural") == 0 and pii._gazetteer("email", "a@b.invalid") == -1
    assert pii._gazetteer("phone", "+380 44 123 45 67") == 1 and pii._gazetteer("phone", "+28 123 456") == -1 and pii._gazetteer("phone", "030 123 456") == 0
    assert pii._gazetteer("card", "2221 0000 0000 0009") == 1 and pii._gazetteer("card", "1234 5678 9012 3456") == -1
    assert pii._gazetteer("ip", "192.168.0.1") == -1 and pii._gazetteer("ip", "97.51.17.173") == 1
    assert pii._context("phone", "please CALL me") == 1 and pii._context("phone", "invoice") == -1 and pii._context("phone", "grass") == 0


def test_masked_mail_of_any_length():
    long = f"{'a' * 5000} (at) {'b' * 300} (dot) museum"
    assert [(k, a, b) for k, a, b, *_ in pii.candidates(f"see {long}.")] == [("email", 4, 4 + len(long))]
    assert pii.candidates("x" * 200_000 + " at " + "y" * 200_000) == []
