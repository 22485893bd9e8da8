"""The kind of a plot from its zone or from what an advertisement says first; kind and municipality with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.functions import codes, text
from plotlens.operators import grid

#: Kinds, and zones of general plans that stand for one.
KINDS = ("mieszkaniowa", "uslugowa", "przemyslowa", "lesna")
ZONE_KINDS = {"SW": "mieszkaniowa", "SJ": "mieszkaniowa", "SZ": "mieszkaniowa", "SU": "uslugowa", "SH": "uslugowa", "SP": "przemyslowa"}
#: What names a kind in a folded text; of two at one place the first listed counts.
PATTERNS = (
    ("przemyslowa", r"przemyslow|produkcyj|magazyn|logistyczn|skladow"),
    ("uslugowa", r"uslugow|handlow|biurow|komercyjn|gastronomiczn|hotelow"),
    ("mieszkaniowa", r"mieszkaniow|budowlan|jednorodzinn|wielorodzinn|siedliskow|zagrodow|pod dom|pod zabudowe(?!\s+(?:uslugow|przemyslow|produkcyj|magazynow|handlow))|\bmn\d*\b|\bmw\d*\b"),
    ("lesna", r"\blesn[aeoy]\b|\blesn(?:ej|ym|ego|ych)\b|zalesion"),
)
#: Characters of a title behind a noun for land that describe it, and where they end before.
WINDOW, ENDS = 40, r"(?s)[,;|\d].*"
#: Fixed value: nouns for land.
NOUNS = r"dzialk\w*|dzialek|grunt\w*|teren\w*|nieruchomosc\w*|parcel\w*"


def first_named(folded: Column) -> Column:
    """The kind whose word stands first in a folded text; null if none does."""
    at = [F.regexp_instr(folded, F.lit(f"(?U){pattern}")) for _, pattern in PATTERNS]
    found = F.array(*[F.when(p > 0, F.struct(p.alias("at"), F.lit(i).alias("i"), F.lit(kind).alias("kind"))) for i, (p, (kind, _)) in enumerate(zip(at, PATTERNS, strict=True))])
    return F.array_min(found)["kind"]


def of_zone(zone: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ZONE_KINDS.items() for x in pair])
    return F.try_element_at(table, F.upper(F.trim(zone)))


def of_purpose(purpose: Column) -> Column:
    return first_named(F.lower(text.fold_polish(purpose)))


def of_title(title: Column) -> Column:
    """From the words behind a noun for land only: the rest of a title is an address, and streets are named after woods."""
    low = F.lower(text.fold_polish(F.coalesce(title, F.lit(""))))
    behind = F.regexp_extract_all(low, F.lit(f"(?Us)(?:{NOUNS})(?=(.{{0,{WINDOW}}}))"), F.lit(1))
    named = F.transform(behind, lambda w: first_named(F.regexp_replace(w, ENDS, "")))
    return F.try_element_at(F.array_compact(named), F.lit(1))


def with_kind(offers: DataFrame) -> DataFrame:
    """With ``kind`` and ``kind_source``: the zone of the general plan before the advertisement, its purpose before its title."""
    zone = of_zone(F.col("zone"))
    said = F.coalesce(of_purpose(F.col("purpose")), of_title(F.col("title")))
    return offers.withColumns({"kind": F.coalesce(zone, said), "kind_source": F.when(zone.isNotNull(), "plan_ogolny").when(said.isNotNull(), "ogloszenie")})


def assigned(offers: DataFrame, sales: DataFrame, size: float = 250.0) -> DataFrame:
    """``(offer_id, kind, kind_source, municipality, municipality_source)`` of every offer.

    Reads ``offer_id, zone, purpose, title, parcel_id, e, n``; ``sales`` has ``(tx_id, municipality,
    e, n)``. The municipality is the matched parcel's, else that of the nearest sale.
    """
    own = codes.municipality(F.col("parcel_id"))
    rows = with_kind(offers).withColumn("__own", own).select("offer_id", "kind", "kind_source", "__own", "e", "n")
    known = sales.where("municipality is not null")
    near = grid.nearest(rows.where("__own is null").select("offer_id", "e", "n"), known, "offer_id", "tx_id", size)
    near = near.join(known.select("tx_id", F.col("municipality").alias("__near")).dropDuplicates(["tx_id"]), "tx_id").select("offer_id", "__near")
    out = rows.join(near, "offer_id", "left")
    source = F.when(F.col("__own").isNotNull(), "dzialka").when(F.col("__near").isNotNull(), "rcn")
    return out.select("offer_id", "kind", "kind_source", F.coalesce("__own", "__near").alias("municipality"), source.alias("municipality_source"))
