"""PII by weak supervision: labelers vote, EM estimates their reliability, a classifier decides.

Every text gives candidate spans: the base spans of four kinds, and looser ones (masked e-mail
addresses, IPv6, cards of other lengths, phone numbers without a country code, base matches that
fail their check). Three labelers vote for or against each candidate or abstain: a regex labeler, a
gazetteer of domains, prefixes and ranges, and a context labeler that looks for words nearby. Votes
and span features have few values, so all candidates of the corpus are summed into a table of
patterns; expectation-maximisation over it estimates each labeler's reliability without labels, and
its posteriors train a logistic span classifier. Base spans always stay; a looser span is added
when the classifier accepts it and no base span overlaps it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.llm.text import input_rows
from plotlens.session import staged

KINDS = ("email", "ip", "card", "phone")
#: Characters before and after a span that the context labeler reads.
NEAR = 40
#: Generic top-level domains; any two letters are a country's. Those that are never registered.
GENERIC = frozenset(
    "com org net edu gov mil int info biz name pro aero coop museum mobi jobs travel tel cat asia post app dev cloud online site shop store tech blog xyz club live news email media agency"
    " bank health law global world today space network solutions services systems software digital".split()
)
RESERVED = frozenset("example invalid test localhost local internal arpa onion".split())
#: Country calling codes of one and two digits, and the two digits that those of three begin with.
CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
CALLING_3 = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Ranges of leading digits that card issuers have.
ISSUERS = (("4", "4"), ("51", "55"), ("2221", "2720"), ("34", "34"), ("37", "37"), ("6011", "6011"), ("644", "649"), ("65", "65"), ("62", "62"),
           ("3528", "3589"), ("300", "305"), ("36", "36"), ("38", "39"), ("50", "50"), ("56", "58"), ("60", "61"), ("63", "63"), ("67", "69"))
#: Starts of addresses that name no single host of the public net.
RESERVED_IPS = ("0.", "10.", "127.", "169.254.", "192.0.2.", "192.168.", "198.51.100.", "203.0.113.", *(f"172.{i}." for i in range(16, 32)), *(f"{i}." for i in range(224, 256)))
#: Words near a span that speak for its kind, and words that speak against any.
FOR = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "kontakt", "schreib", "escrib", "adress", "address", "@"),
    "ip": ("ip", "host", "server", "address", "adresse", "direcc", "login", "client", "logged", "connect", "visit", "vpn", "proxy"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment", "mastercard", "amex", "debit", "bezahl", "paie", "pago"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "sms", "ring", "handy", "anruf", "llama", "appel", "portable", "móvil"),
}
AGAINST = (
    "version", "release", "isbn", "issn", "section", "chapter", "order n", "invoice", "build", "serial", "part n", "model", "figure", "table", "page", "ticket", "article", "sku",
    "rechnung", "bestell", "factura", "pedido", "facture", "commande",
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Possessive repeats between fixed words keep the search linear, so no part needs a longest length.
_MASKED = re.compile(r"(?<![\w.+-])[\w.+-]++ ?[(\[ ]at[)\] ] ?[A-Za-z0-9-]++ ?[(\[ ]dot[)\] ] ?[A-Za-z]{2,}+\b", re.A)
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])", re.A)
_LOCAL_PHONE = re.compile(r"(?<![\w+.)-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w.-])", re.A)
_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each ``@`` outwards, so in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def candidates(text: str) -> list[tuple[str, int, int, bool, int]]:
    """``(kind, start, end, base, checked)`` of a text, by kind and start; ``checked``: 1 passes, -1 fails, 0 neither.

    Base matches that fail their check come back as candidates that the regex labeler votes against.
    """
    out = []
    if "@" in text:
        out += [("email", a, b, True, 1) for a, b in _emails(text)]
    if " at " in text or "(at)" in text or "[at]" in text:
        out += [("email", *m.span(), False, 0) for m in _MASKED.finditer(text)]
    if "." in text:
        for m in _IP.finditer(text):
            good = all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))
            out.append(("ip", *m.span(), good, 1 if good else -1))
    if ":" in text:
        out += [("ip", *m.span(), False, 0) for m in _IP6.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19:
                passes = luhn(digits)
                base = passes and len(digits) >= 16
                out.append(("card", *m.span(), base, 1 if base else 0 if passes else -1))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_DIGITS.sub("", m[0]))
            out.append(("phone", *m.span(), 8 <= n <= 15, 1 if 8 <= n <= 15 else -1))
    out += [("phone", *m.span(), False, 0) for m in _LOCAL_PHONE.finditer(text)]
    out.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return out


def _gazetteer(kind: str, span: str) -> int:
    digits = _DIGITS.sub("", span)
    if kind == "email":
        top = re.split(r"[. ]", span)[-1].lower()
        return 1 if top in GENERIC or (len(top) == 2 and top.isalpha()) else -1 if top in RESERVED or top.isdigit() else 0
    if kind == "card":
        return 1 if any(low <= digits[: len(low)] <= high for low, high in ISSUERS) else -1
    if kind == "phone":
        known = digits[:1] in CALLING or digits[:2] in CALLING or digits[:2] in CALLING_3
        return (1 if known else -1) if span[0] == "+" else 0
    return 0 if ":" in span else -1 if span.startswith(RESERVED_IPS) else 1


def _context(kind: str, around: str) -> int:
    around = around.lower()
    if any(w in around for w in FOR[kind]):
        return 1
    return -1 if any(w in around for w in AGAINST) else 0


def pattern_of(text: str, kind: str, start: int, end: int, checked: int) -> int:
    """Votes and features of a candidate in one small number: three votes of three values, then four bits."""
    span = text[start:end]
    around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
    code = 0
    for vote in (checked, _gazetteer(kind, span), _context(kind, around)):
        code = 3 * code + vote + 1
    n = sum(c.isdigit() for c in span)
    joins = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    for bit in (n >= 10, 2 * n >= end - start, joins, " " in span or "-" in span):
        code = 2 * code + bit
    return code


def estimate(kinds: np.ndarray, codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[dict, np.ndarray]:
    """Reliabilities of the labelers by kind, and the classifier's score of each pattern.

    EM over the pattern counts, with a two-class model in which each labeler votes -1 or 1 by its
    own probabilities or abstains, which says nothing; then logistic regression of the posteriors on
    votes and features.
    """
    votes = np.stack([codes // 16 // 9, codes // 16 // 3 % 3, codes // 16 % 3], axis=1)
    posterior, reliability = np.zeros(len(codes)), {}
    for kind in range(len(KINDS)):
        own = kinds == kind
        if not own.any():
            continue
        v, n = votes[own], counts[own].astype(float)
        good = np.clip(0.5 + 0.2 * (v - 1).sum(axis=1), 0.05, 0.95)
        for _ in range(rounds):
            prior = np.clip((n * good).sum() / n.sum(), 0.02, 0.98)
            like, tables = np.log([1 - prior, prior])[None, :].repeat(len(v), 0), []
            for k in range(3):
                table = np.stack([np.bincount(v[:, k], n * w, 3) for w in (1 - good, good)]) + np.array([[2, 0, 0.5], [0.5, 0, 2]])
                table[:, 1] = 0  # of those that do not abstain
                table /= table.sum(axis=1, keepdims=True)
                table[:, 1] = 1
                tables.append(table)
                like += np.where(v[:, k, None] == 1, 0, np.log(table[:, v[:, k]]).T)
            good = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        posterior[own], reliability[KINDS[kind]] = good, [float(t[1, 2] + t[0, 0]) / 2 for t in tables]
    bits = np.stack([codes >> b & 1 for b in range(4)], axis=1)
    x = np.concatenate([np.eye(len(KINDS))[kinds], *(np.eye(3)[votes[:, k]] for k in range(3)), bits], axis=1)
    w, share = np.zeros(x.shape[1]), counts / max(1, counts.sum())
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (share * (p - posterior)) + 1e-3 * w)
    return reliability, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, found)``: the candidates of each row, as structs with their pattern; null texts have none."""
    rows = input_rows(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = value.as_py() or ""
                found.append([
                    {"kind": k, "start": a, "end": b, "base": base, "pattern": pattern_of(text, k, a, b, checked)}
                    for k, a, b, base, checked in candidates(text)
                ])
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(item))], names=["id", "found"])

    schema = f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean,pattern:int>>"
    return rows.mapInArrow(each, schema)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``(id, spans)`` of every row: base spans and accepted ones, by kind and start.

    A looser span needs a labeler that votes for it, none of its own check against it, and a score
    of ``least``. A null text counts as empty; repeated rows give repeated results; an empty table
    an empty one. At most a row for each kind and pattern, 1,728 in all, reaches the driver.
    """
    found = staged(find_candidates(docs, id_col, text_col), "pii-candidates")
    patterns = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.pattern").agg(F.count("*").alias("n")).collect()
    accepted: list[str] = []
    if patterns:
        kinds = np.array([KINDS.index(r["kind"]) for r in patterns])
        codes, counts = np.array([r["pattern"] for r in patterns]), np.array([r["n"] for r in patterns])
        _, score = estimate(kinds, codes, counts)
        votes = np.stack([codes // 16 // 9, codes // 16 // 3 % 3, codes // 16 % 3])
        good = (score >= least) & (votes == 2).any(axis=0) & (votes[0] > 0)
        accepted = sorted(f"{r['kind']}:{r['pattern']}" for r, ok in zip(patterns, good, strict=True) if ok)
    good = F.array(*[F.lit(a) for a in accepted]).cast("array<string>")
    base = F.filter("found", lambda s: s["base"])
    added = F.filter(
        "found",
        lambda s: ~s["base"]
        & F.array_contains(good, F.concat_ws(":", s["kind"], s["pattern"].cast("string")))
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    spans = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")),
    )
    return found.withColumn("base", base).withColumn("added", added).select("id", F.array_sort(spans).alias("spans"))


def how_many(field: str, value: str, only_base: bool = False) -> Column:
    """The number of spans whose ``field`` is ``value``."""
    return F.size(F.filter("spans", lambda s: (s[field] == value) & (s["base"] | (not only_base)))).cast("bigint")


def joined(spans, only_base: bool = False):
    """``kind:start:end`` of the spans, comma-joined."""
    if only_base:
        spans = F.filter(spans, lambda s: s["base"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, base counts by kind, ``base_sha256`` and ``spans``."""
    out = find_pii(docs, id_col, text_col)
    counts = [how_many("kind", k, only_base=True).alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(joined("spans", True).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
