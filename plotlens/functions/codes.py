"""Area codes, market segments and their fixed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Land-use fragments and the segment each stands for; the first that occurs decides.
LAND_USE = (
    ("budownictwomieszkaniowewielorodzinne", "mieszkaniowa_wielorodzinna"),
    ("budownictwomieszkaniowejednorodzinne", "mieszkaniowa_jednorodzinna"),
    ("zabudowazagrodowa", "mieszkaniowa_jednorodzinna"),
    ("terenzabudowyuslugowej", "uslugowa_produkcyjna"),
    ("produkcyj", "uslugowa_produkcyjna"),
    ("przemysl", "uslugowa_produkcyjna"),
    ("skladow", "uslugowa_produkcyjna"),
    ("sportuirekreacji", "rekreacyjna"),
    ("rekreacyj", "rekreacyjna"),
    ("letnisk", "rekreacyjna"),
    ("terendrog", "droga"),
    ("komunikacj", "droga"),
    ("terenrolnicz", "rolna"),
    ("terenlesn", "lesna"),
    ("lasow", "lesna"),
    ("decyzjawarunkizabudowy", "budowlana_wz"),
)
#: The same for the register's use, where the land use says nothing.
REGISTER_USE = (
    ("gruntylesne", "lesna"),
    ("terenykomunikacyjne", "droga"),
    ("gruntyzabudowaneizurbanizowane", "nieokreslona_zurbanizowana"),
    ("gruntyrolne", "nieokreslona_rolna"),
)
#: Land uses that say nothing.
NO_LAND_USE = ("brakmpzplubwz", "innyniewymieniony")
#: The segment of an advertisement by fragments of its text.
AD_TEXT = (
    ("wielorodzinn", "mieszkaniowa_wielorodzinna"),
    ("budowlan", "mieszkaniowa_jednorodzinna"),
    ("pod zabudowe", "mieszkaniowa_jednorodzinna"),
    ("pod dom", "mieszkaniowa_jednorodzinna"),
    ("siedliskow", "mieszkaniowa_jednorodzinna"),
    ("uslugow", "uslugowa_produkcyjna"),
    ("przemyslow", "uslugowa_produkcyjna"),
    ("inwestycyjn", "uslugowa_produkcyjna"),
    ("magazynow", "uslugowa_produkcyjna"),
    ("rekreacyjn", "rekreacyjna"),
    ("letnisk", "rekreacyjna"),
    ("siedlisko", "mieszkaniowa_jednorodzinna"),
    ("gospodarstwo", "rolna"),
    ("roln", "rolna"),
    ("orn", "rolna"),
    ("lesn", "lesna"),
    ("las ", "lesna"),
)
#: Segments that may be added, in this order, where a segment has too few sales.
WIDENING = {
    "mieszkaniowa_wielorodzinna": ("mieszkaniowa_jednorodzinna", "uslugowa_produkcyjna"),
    "mieszkaniowa_jednorodzinna": ("budowlana_wz", "mieszkaniowa_wielorodzinna", "uslugowa_produkcyjna"),
    "budowlana_wz": ("mieszkaniowa_jednorodzinna", "uslugowa_produkcyjna"),
    "uslugowa_produkcyjna": ("mieszkaniowa_jednorodzinna", "budowlana_wz"),
    "rekreacyjna": ("mieszkaniowa_jednorodzinna", "rolna"),
    "rolna": ("lesna", "rekreacyjna"),
    "lesna": ("rolna",),
    "droga": ("rolna", "nieokreslona"),
    "nieokreslona_zurbanizowana": ("nieokreslona", "mieszkaniowa_jednorodzinna"),
    "nieokreslona_rolna": ("nieokreslona", "rolna"),
    "nieokreslona": ("nieokreslona_zurbanizowana", "nieokreslona_rolna"),
}


def _once(text: Column, found: Callable[[Column], Column]) -> Column:
    """``found`` of a text that is computed once: in place of its name it would be computed, and its code generated, for each rule anew."""
    return F.get(F.transform(F.array(text), found), F.lit(0))


def _first(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for fragment, value in reversed(rules):
        out = F.when(F.contains(text, F.lit(fragment)), F.lit(value)).otherwise(out)
    return out


def first_match(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first rule whose fragment occurs in ``text``; null if none does."""
    return _once(text, lambda t: _first(t, rules))


def segment(land_use: Column, register_use: Column) -> Column:
    """The market segment of a sale from its land use, else from the register's use."""
    squeezed = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    by_plan = _once(squeezed(land_use), lambda t: F.when(~t.isin(*NO_LAND_USE), _first(t, LAND_USE)))
    return F.coalesce(by_plan, first_match(squeezed(register_use), REGISTER_USE), F.lit("nieokreslona"))


def ad_segment(text: Column) -> Column:
    """The market segment that an advertisement's folded text names; null if it names none."""
    return first_match(text, AD_TEXT)


def has_municipality(parcel_id: Column) -> Column:
    """Whether ``municipality`` is known."""
    return parcel_id.rlike(r"^\d{6}_\d\.")


def municipality(parcel_id: Column) -> Column:
    """``226101_1.0091.81/23`` -> ``2261011``; null for ids of another form."""
    return F.when(has_municipality(parcel_id), F.concat(F.substring(parcel_id, 1, 6), F.substring(parcel_id, 8, 1)))


def precinct(parcel_id: Column) -> Column:
    """The first two parts of a parcel id; null for ids of another form."""
    return F.when(parcel_id.rlike(r"^\d{6}_\d\.\d+\."), F.substring_index(parcel_id, ".", 2))


def parcel_id(prefix: Column, precinct_no: Column, number: Column) -> Column:
    return F.concat_ws(".", prefix, F.lpad(precinct_no, 4, "0"), number)


def display_name(name: Column, code: Column) -> Column:
    """A municipality's name with the suffix that the last digit of its code asks for."""
    last = F.right(code, F.lit(1))
    return F.when(last == "4", F.concat(name, F.lit(" (miasto)"))).when(last == "5", F.concat(name, F.lit(" (obszar wiejski)"))).otherwise(name)
