"""Text functions: folding, tokens, parsed amounts, keys and extracted sentences. Columns only."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish letters with marks and the plain ones they fold to.
POLISH, PLAIN = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"
#: Words of a title that say nothing about a plot.
STOPWORDS = (
    "dzialka", "dzialki", "dzialke", "grunt", "gruntu", "teren", "na", "nad", "pod", "przy", "w", "we", "z", "za", "do", "i", "oraz",
    "sprzedam", "sprzedaz", "sprzedazy", "oferta", "okazja", "polecam", "m2", "mkw", "ar", "ary", "arow", "ha", "zl", "pln",
)
#: Building symbols of local plans, longest first, and building zones of general plans.
LOCAL_SYMBOLS = ("MNU", "MN", "MW", "MU", "UM", "RM", "MP", "ML", "U")
BUILDING_ZONES = ("SW", "SJ", "SZ", "SU", "SH", "SP")
#: Utilities and the words that name them in a text, and in the value of a label.
UTILITIES = (
    ("prad", ("prad", "energia elektryczna", "elektryczn")), ("woda", ("wodociag", "woda miejska", "przylacze wody", "woda ")),
    ("gaz", ("gaz",)), ("kanalizacja", ("kanaliza",)),
)
LABEL_UTILITIES = (("prad", ("prad", "elektr")), ("woda", ("woda", "wodociag")), ("gaz", ("gaz",)), ("kanalizacja", ("kanaliz",)), ("szambo", ("szambo",)), ("oczyszczalnia", ("oczyszczalnia",)))
#: Words in a title of what is no land.
NOT_LAND = ("mieszkanie", "apartament", "kawalerka", "lokal", "hala", "garaż")
#: What begins a sentence on planning, what may be one on access by road, and what must be in that one.
PLANNING = r"(?i)(?:MPZP|plan(?:em|u)? (?:miejscow|zagospodarowania))[^.]{0,160}"
ACCESS = r"(?i)[^.]{0,80}(?:dojazd|droga dojazdowa|wjazd|przy drodze|przy drog[ae])[^.]{0,120}"
SURFACE = r"(?i)asfalt|utwardz|szutrow|gruntow|droga (?:gminn|powiatow|publiczn|wewnetrzn)|slepa|serwitut|sluzebnos"
#: A pattern of an area in a title, behind a word for it in a text, and at three places of a page; a label and its value.
AREA_IN_TITLE = r"(\d[\d\s\u00a0]*)\s*m²"
AREA_IN_TEXT = r"(?i)pow(?:ierzchni[aei])?\.?\s*(?:ok\.?\s*)?(\d[\d\s\u00a0]*)\s*m[²2]"
AREA_IN_PAGE = (r"<title>[^<]*?(\d[\d\s\u00a0]*)\s*m²", r'"floorSize"[^}]*?"value"\s*:\s*"?([\d.,]+)', r"(\d[\d\s\u00a0]*)\s*m²\s*</")
LABEL = r"<(?:span|strong|b|dt|th)[^>]*>\s*([A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż ]{3,28}):\s*</(?:span|strong|b|dt|th)>\s*(?:<[^>]+>\s*)*([^<]{1,80})"
#: Codes of a portal's fields and the words for them.
PLOT_TYPES = {
    "building": "budowlana", "agricultural": "rolna", "recreational": "rekreacyjna", "investment": "inwestycyjna", "industrial": "przemyslowa", "habitat": "siedliskowa", "forest": "lesna",
}
MEDIA_TYPES = {"electricity": "prad", "water": "woda", "gas": "gaz", "sewage": "kanalizacja", "sewerage": "kanalizacja"}
#: Bounds of a plausible price in grosze and of an area in square metres.
PRICE_BOUNDS, AREA_BOUNDS = (10_000, 50_000_000_000), (50.0, 5_000_000.0)


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Letters and what they fold to, by rule: the compatibility decomposition without its marks; marks go."""
    pairs, marks = [("ł", "l"), ("Ł", "L")], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or letter in "łŁ":
            continue
        if unicodedata.combining(letter):
            marks.append(letter)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != letter:
            pairs.append((letter, plain))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """``text`` with plain letters for marked ones of any script; letters that decompose into several stay."""
    return F.translate(text, *_folding())


def fold_polish(text: Column) -> Column:
    return F.translate(text, POLISH, PLAIN)


def tokens(title: Column, dropped: tuple[str, ...] = STOPWORDS) -> Column:
    """The distinct telling words of a title, sorted; a null title has none."""
    words = F.split(F.regexp_replace(F.lower(fold(F.coalesce(title, F.lit("")))), "[^0-9a-z]+", " "), " ")
    kept = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.array_except(kept, F.array(*[F.lit(w) for w in dropped]))))


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller token set that is in the other; 0 if one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def price_grosze(text: Column) -> Column:
    """A price text in grosze; null if it has no number or one beyond the bounds.

    A single comma is decimal; dots are thousands if there are several or three digits follow the
    only one; a comma beside a single other dot is a thousands mark.
    """
    low = F.lower(F.regexp_replace(text, "[ \u00a0\u2009\u202f]", ""))
    digits = F.regexp_replace(F.regexp_replace(low, "zl|zł|pln", ""), r"[^\d,.]", "")
    commas, dots = _count(digits, ","), _count(digits, ".")
    thousands = (dots > 1) | ((dots == 1) & (F.length(F.substring_index(digits, ".", -1)) == 3))
    number = (
        F.when((commas == 1) & (dots == 0), F.replace(digits, F.lit(","), F.lit(".")))
        .when(thousands, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(F.replace(digits, F.lit(","), F.lit("")))
    )
    grosze = F.bround(number.try_cast("double") * 100).cast("bigint")
    return F.when(grosze.between(*PRICE_BOUNDS), grosze)


def area_m2(text: Column) -> Column:
    """An area text in whole square metres: the first number with a unit (``m2``, ``a`` or ``ar...``, ``ha`` or
    ``hektar...``), else all digits; null if unreadable or beyond the bounds."""
    squeezed = F.regexp_replace(text, "[ \u00a0\u2009\u202f]", "")
    pattern = r"(?iU)(\d+(?:[.,]\d+)?)\s*(m2|m²|mkw|ha|hektar\w*|ar\w*|a)\b"
    number, unit = F.regexp_extract(squeezed, pattern, 1), F.lower(F.regexp_extract(squeezed, pattern, 2))
    times = F.when(unit.startswith("h"), 10_000).when(unit.startswith("a"), 100).otherwise(1)
    bare = F.replace(F.regexp_replace(squeezed, r"[^\d,.]", ""), F.lit(","), F.lit(".")).try_cast("double")
    area = F.bround(F.when(unit != "", F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * times).otherwise(bare)).cast("bigint")
    return F.when(area.between(*AREA_BOUNDS), area)


def field_number(text: Column, strict: bool = True) -> Column:
    """A number in a field of a page; ``strict`` takes spaces out only, else all but digits and marks."""
    kept = F.regexp_replace(text, "[ \u00a0]" if strict else r"[^\d.,]", "")
    return F.replace(kept, F.lit(","), F.lit(".")).try_cast("double")


def field_grosze(text: Column, strict: bool = True) -> Column:
    return F.bround(field_number(text, strict) * 100).cast("bigint")


def field_m2(text: Column, strict: bool = True) -> Column:
    return F.bround(field_number(text, strict)).cast("bigint")


def phone_hash(phone: Column) -> Column:
    """SHA-256 of a phone's digits, without a 48 before nine others; null under nine digits."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    local = F.when((F.length(digits) == 11) & digits.startswith("48"), F.substring(digits, 3, 9)).otherwise(digits)
    return F.when(F.length(local) >= 9, F.sha2(local, 256))


def hash_bits(text: Column) -> Column:
    """A 64-bit picture hash as a number: from bits if it has only zeros and ones, else from hex digits."""
    trimmed = F.trim(text)
    number = lambda base: F.conv(trimmed, base, -10).try_cast("bigint")
    return F.when(trimmed != "", F.when(trimmed.rlike("^[01]+$"), number(2)).otherwise(number(16)))


def image_key(url: Column) -> Column:
    """The address a thumbnail stands for: decoded from the relay's path, else the url without its query."""
    coded = F.regexp_extract(url, "/thumb/([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(coded, "-_", "+/"), (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
    plain = F.try_to_binary(padded, F.lit("base64")).try_cast("string")
    known = (F.length(coded) > 0) & plain.startswith("http")
    return F.substring_index(F.when(known, plain).otherwise(url), "?", 1)


def local_symbol(symbol: Column) -> Column:
    """``12MN/U`` -> ``MN``: the longest known start of its letters, else the first three."""
    letters = F.regexp_replace(F.upper(F.coalesce(symbol, F.lit(""))), r"[^\p{L}]", "")
    out = F.substring(letters, 1, 3)
    for known in reversed(LOCAL_SYMBOLS):
        out = F.when(letters.startswith(known), F.lit(known)).otherwise(out)
    return F.when(F.length(letters) > 0, out)


def indicator(text: Column) -> Column:
    """A planning indicator; ``-``, ``brak``, ``nie dotyczy`` and blanks are unknown."""
    number = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(~number.isin("", "-", "brak", "nie dotyczy"), number.try_cast("double"))


def utilities(text: Column, named: tuple[tuple[str, tuple[str, ...]], ...] = UTILITIES) -> Column:
    """A map of the utilities that a text names, all true; null if it names none."""
    low = F.lower(fold_polish(F.coalesce(text, F.lit(""))))
    found = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, words in named]))
    return F.when(F.size(found) > 0, F.map_from_entries(F.transform(found, lambda n: F.struct(n, F.lit(True)))))


def known_codes(codes: Column, names: dict[str, str], keep_unknown: bool = False) -> Column:
    """The words for an array of codes; an unknown code is left out or, with ``keep_unknown``, stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    word = lambda c: F.coalesce(F.try_element_at(table, c), c) if keep_unknown else F.try_element_at(table, c)
    return F.array_compact(F.transform(codes, word))


def planning_sentence(*texts: Column, most: int = 300) -> Column:
    """From the first mention of a local plan to the end of its sentence, in the first text that has one."""
    found = [F.nullif(F.substring(without_tags(F.regexp_extract(F.coalesce(t, F.lit("")), PLANNING, 0)), 1, most), F.lit("")) for t in texts]
    return F.coalesce(*found)


def road_access(text: Column, most: int = 200) -> Column:
    """The first sentence on access that also names the road or its surface."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ACCESS), F.lit(0)), without_tags)
    fit = F.filter(found, lambda s: F.rlike(s, F.lit(SURFACE)))
    return F.nullif(F.substring(F.try_element_at(fit, F.lit(1)), 1, most), F.lit(""))


def frontage(text: Column) -> Column:
    """The shorter side of dimensions such as ``24m x 25m``; null under two numbers of metres."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)?)\s*m"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    return F.when(F.size(found) >= 2, F.array_min(found))


def area_in_title(title: Column) -> Column:
    """``1 204 m²`` anywhere in a title."""
    return field_m2(F.nullif(F.regexp_replace(F.regexp_extract(title, AREA_IN_TITLE, 1), r"\s", ""), F.lit("")))


def area_in_text(text: Column) -> Column:
    """The first area behind a word for it, as in ``o pow. ok. 1250 m2``."""
    found = F.regexp_extract(text, AREA_IN_TEXT, 1)
    return field_m2(F.nullif(F.regexp_replace(found, r"\s", ""), F.lit("")))


def area_in_page(html: Column) -> Column:
    """An area in a page: in its title, in its data, or at the end of an element; zero is none."""
    return F.coalesce(*[F.nullif(field_m2(F.nullif(F.regexp_replace(F.regexp_extract(html, p, 1), r"\s", ""), F.lit(""))), F.lit(0)) for p in AREA_IN_PAGE])


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def labels(html: Column) -> Column:
    """``<b>label:</b> value`` pairs as a map with folded keys; of equal labels the first with a value wins."""
    part = lambda i: F.regexp_extract_all(html, F.lit(LABEL), F.lit(i))
    pairs = F.zip_with(part(1), part(2), lambda k, v: F.struct(F.lower(fold_polish(F.trim(k))).alias("k"), F.trim(F.regexp_replace(v, r"\s+", " ")).alias("v")))
    known = F.filter(pairs, lambda p: p["v"] != "")
    keys = F.transform(known, lambda p: p["k"])
    return F.map_from_entries(F.filter(known, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def properties(pairs: Column) -> Column:
    """An array of ``(name, value)`` as a map with lower-case keys; of equal names the last wins, those without one are left out."""
    known = F.filter(pairs, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    clean = F.transform(known, lambda p: F.struct(F.lower(F.trim(p["name"])).alias("k"), F.trim(F.coalesce(p["value"], F.lit(""))).alias("v")))
    keys = F.transform(clean, lambda p: p["k"])
    return F.map_from_entries(F.filter(clean, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"])))


def content_hash(*fields: Column) -> Column:
    """32 hex digits that change when one of the fields does."""
    return F.substring(F.sha2(F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)])), 256), 1, 32)


def looks_like_land(title: Column, area: Column) -> Column:
    """A plausible area, and no word in the title for what is no land; a null title has none."""
    low = F.lower(F.coalesce(title, F.lit("")))
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in NOT_LAND])
    return F.coalesce(area.between(*AREA_BOUNDS), F.lit(False)) & ~named


def offer_number(url: Column, pattern: str = r"[-,/_]([0-9]{4,})(?:[/.?#].*)?$") -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def without_contacts(features: Column, names: tuple[str, ...] = ("phone", "telefon", "email", "contact", "kontakt")) -> Column:
    """A map without the keys that hold contact data."""
    return F.map_filter(features, lambda k, _: ~F.lower(k).isin(*names))
