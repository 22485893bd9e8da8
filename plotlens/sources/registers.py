"""Readers of register replies: sales, parcels and acts in XML, map-service fields, pipe-delimited lookups, region seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.functions import codes, dates, geo

#: Schema of a sale in the register's XML, below its row tag.
SALE = (
    "iip_id string, id_dzialki string, teryt_powiat string, data_trans string, dzi_cena_brutto string, tran_cena_brutto string, pow_gruntu string, "
    "przeznaczenie string, sposob_uzyt string, rodzaj_rynku string, rodzaj_trans string, nier_rodzaj string, udzial string, geometria string"
)


def whole(text: Column) -> Column:
    """A whole number with spaces of any kind in it; null if it is none."""
    return F.regexp_replace(text, "[\\s   ]+", "").try_cast("bigint")


def ring(positions: Column, easting_first: bool = False) -> Column:
    """A list of coordinates as a closed ring of ``(e, n)``; registers give northing first unless said otherwise."""
    numbers = F.transform(F.filter(F.split(F.trim(positions), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), (F.size(numbers) / 2).cast("int"))),
        lambda i: F.struct(F.try_element_at(numbers, 2 * i - (1 if easting_first else 0)).alias("e"), F.try_element_at(numbers, 2 * i - (0 if easting_first else 1)).alias("n")),
    )
    closed = F.when(F.element_at(pairs, 1) == F.element_at(pairs, -1), pairs).otherwise(F.concat(pairs, F.array(F.element_at(pairs, 1))))
    return F.when(F.size(numbers) >= 6, closed)


def easting_first(srs: Column) -> Column:
    """Axis order by the form of the reference system's name: urn names are northing first."""
    return ~F.contains(srs, F.lit("urn:ogc:def:crs"))


def read_sales(spark: SparkSession, path: str, row_tag: str = "dzialki", schema: str = SALE, srs: str | None = None) -> DataFrame:
    """Typed sales from XML: the plot's price before the transaction's, in grosze; lenient dates.

    ``srs`` is the name of the reference system as the reply gives it; its form tells the axis order.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)
    cost = F.coalesce(F.nullif(whole(F.col("dzi_cena_brutto")), F.lit(0)), whole(F.col("tran_cena_brutto")))
    outline = F.when(easting_first(F.lit(srs or "")) & F.lit(bool(srs)), ring(F.col("geometria"), True)).otherwise(ring(F.col("geometria")))
    return raw.select(
        "iip_id", "id_dzialki", "teryt_powiat", dates.iso_prefix(F.col("data_trans")).alias("sale_date"), (cost * 100).alias("price_grosze"), whole(F.col("pow_gruntu")).cast("int").alias("area_m2"),
        "przeznaczenie", "sposob_uzyt", "rodzaj_rynku", "rodzaj_trans", "nier_rodzaj", "udzial", outline.alias("ring"),
    )


#: A polygon in XML: outline and holes as position lists, and the name of the reference system.
_LINEAR = "LinearRing struct<posList:string>"
POLYGON = f"_srsName string, exterior struct<{_LINEAR}>, interior array<struct<{_LINEAR}>>"
_SURFACE = f"surfaceMember array<struct<Polygon struct<{POLYGON}>>>"
GEOMETRY = f"Polygon array<struct<{POLYGON}>>, MultiSurface struct<_srsName string, {_SURFACE}>"


def polygons(geometry: Column) -> Column:
    """All polygons of a geometry, each as its outline and the holes behind it; a polygon without an outline is left out."""
    members = F.transform(geometry["MultiSurface"]["surfaceMember"], lambda m: m["Polygon"])
    every = F.concat(F.coalesce(geometry["Polygon"], F.array().cast(f"array<struct<{POLYGON}>>")), F.coalesce(members, F.array().cast(f"array<struct<{POLYGON}>>")))
    outer = geometry["MultiSurface"]["_srsName"]

    def rings(p: Column) -> Column:
        srs = F.coalesce(p["_srsName"], outer)
        first = F.coalesce(easting_first(srs), F.lit(False))  # without a name as with an urn
        read = lambda text: F.when(first, ring(text, True)).otherwise(ring(text))
        holes = F.transform(F.coalesce(p["interior"], F.array().cast(f"array<struct<{_LINEAR}>>")), lambda h: read(h["LinearRing"]["posList"]))
        return F.array_compact(F.concat(F.array(read(p["exterior"]["LinearRing"]["posList"])), holes))

    good = F.filter(every, lambda p: F.coalesce(F.trim(p["exterior"]["LinearRing"]["posList"]) != "", F.lit(False)))
    out = F.transform(good, rings)
    return F.when(F.size(out) > 0, out)


def read_parcels(spark: SparkSession, path: str, row_tag: str = "dzialki") -> DataFrame:
    """Cadastral parcels from XML with their polygons, area and codes; features without an id are left out."""
    fields = "ID_DZIALKI string, NUMER_DZIALKI string, NUMER_OBREBU string, NAZWA_OBREBU string, NAZWA_GMINY string, DATA string"
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(f"{fields}, geom struct<{GEOMETRY}>, msGeometry struct<{GEOMETRY}>").load(path)
    known = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    shape = F.coalesce(polygons(F.col("geom")), polygons(F.col("msGeometry")))
    rows = raw.where(known("ID_DZIALKI").isNotNull()).select(
        known("ID_DZIALKI").alias("parcel_id"), known("NUMER_DZIALKI").alias("number"), known("NUMER_OBREBU").alias("precinct_no"), known("NAZWA_OBREBU").alias("precinct_name"),
        known("NAZWA_GMINY").alias("municipality_name"), dates.iso_prefix(F.col("DATA")).alias("date"), shape.alias("polygons"),
    )
    area = geo.polygons_area(F.col("polygons"))
    municipality, precinct = codes.municipality(F.col("parcel_id")), codes.precinct(F.col("parcel_id"))
    return rows.select("*", F.when(F.col("polygons").isNotNull(), area).alias("area_m2"), municipality.alias("municipality"), precinct.alias("precinct"))


def read_acts(spark: SparkSession, path: str, row_tag: str = "AktPlanowaniaPrzestrzennego") -> DataFrame:
    """Acts of spatial planning from XML: nested ids, linked status and type, date, polygons, the municipality of the name space."""
    schema = (
        "idIIP struct<Identyfikator struct<lokalnyId string, przestrzenNazw string>>, tytul string, obowiazujeOd string, status struct<_href string>, typPlanu struct<_href string>, "
        f"zasiegPrzestrzenny struct<{GEOMETRY}>"
    )
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)
    space = F.coalesce(F.col("idIIP.Identyfikator.przestrzenNazw"), F.lit(""))
    code = F.substring_index(F.substring_index(space, "/", -1), "-", 1)
    return raw.select(
        F.coalesce("idIIP.Identyfikator.lokalnyId", F.lit("")).alias("act"), space.alias("name_space"), F.nullif(F.trim("tytul"), F.lit("")).alias("title"), dates.iso_prefix(F.col("obowiazujeOd")).alias("since"),
        F.col("status._href").alias("status"), F.col("typPlanu._href").alias("kind"), polygons(F.col("zasiegPrzestrzenny")).alias("polygons"),
        F.coalesce(F.contains("status._href", F.lit("legalForce")), F.lit(False)).alias("in_force"), F.when(code.rlike(r"^\d{6,}$"), code).alias("municipality"),
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``(code, name, e_min, n_min, e_max, n_max)`` from a JSON map of codes to names and boxes in degrees; other entries are left out.

    A box in degrees is none in metres, so that around its four corners is taken.
    """
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "entry")).where(F.col("code").rlike(r"^\d+$"))
    rows = entries.select("code", F.from_json("entry", "nazwa string, lat array<double>, lon array<double>").alias("r"))
    corners = F.array(*[geo.from_wgs84(F.col("r.lat")[i], F.col("r.lon")[j]) for i in (0, 1) for j in (0, 1)])
    return rows.select("code", F.col("r.nazwa").alias("name"), geo.bounds(corners).alias("b")).select("code", "name", "b.*")


def usable_for_models(share: Column, trade: Column, price: Column, area: Column) -> Column:
    return (share.isNull() | (share == "1/1")) & (trade == "wolnyRynek") & (price > 0) & (area > 0)


def read_lookups(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """The first row of each pipe-delimited reply as ``fields``, with its ``file``, and ``problem`` where there is none to be had.

    A negative status says that nothing was found and gives no row. ``problem`` names an empty reply,
    an unknown status, a reply without its row or with too few fields, and a row without an id.
    """
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = spark.read.text(path, wholetext=True).select(lines.alias("lines"), F.col("_metadata.file_name").alias("file"))
    status = F.split(F.get("lines", F.lit(0)), r"\s+")[0].try_cast("int")
    cells = F.split(F.get("lines", F.lit(1)), r"\|")
    value = lambda i: F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit(""))
    problem = (
        F.when(F.size("lines") == 0, "empty").when(status.isNull(), "unknown status").when(F.size("lines") < 2, "no row")
        .when(F.size(cells) < len(fields), "too few fields").when(value(0).isNull(), "no id")
    )
    rows = text.where(status.isNull() | (status >= 0))
    return rows.select("file", problem.alias("problem"), *[F.when(problem.isNull(), value(i)).alias(name) for i, name in enumerate(fields)])


def read_fields(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Flat features as maps of their known fields; boxes and coordinates are no fields, and a feature without any is left out.

    Names are taken from the text of each feature, so files need not agree on them and no pass infers a schema.
    """
    body = rf"(?s)<(?:\w+:)?{row_tag}[ >].*?</(?:\w+:)?{row_tag}>"
    features = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(body), F.lit(0))).alias("f"))
    pattern = r"<(?:\w+:)?(\w+)(?: [^>]*)?>([^<]*)</"
    part = lambda i: F.regexp_extract_all("f", F.lit(pattern), F.lit(i))
    pairs = F.filter(F.zip_with(part(1), part(2), lambda k, v: F.struct(k.alias("k"), F.trim(v).alias("v"))), lambda p: (p["v"] != "") & ~p["k"].isin("boundedBy", "Box", "coordinates"))
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return features.select(F.map_from_entries(last).alias("fields")).where(F.size("fields") > 0)


def imported(rows: DataFrame, counties: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sales to be stored, of the wanted counties only and dated, and one row that counts what is left out."""
    dated = F.col("sale_date").isNotNull()
    wanted = F.col("teryt_powiat").isin(*counties) if counties else F.lit(True)
    usable = F.coalesce(usable_for_models(F.col("udzial"), F.col("rodzaj_trans"), F.col("price_grosze"), F.col("area_m2")), F.lit(False))
    kept = dated & F.coalesce(wanted, F.lit(False))
    counts = rows.agg(F.count("*").alias("read"), F.count_if(~dated).alias("undated"), F.count_if(dated & ~F.coalesce(wanted, F.lit(False))).alias("elsewhere"), F.count_if(kept).alias("kept"), F.count_if(kept & usable).alias("usable"))
    return rows.where(kept), counts
