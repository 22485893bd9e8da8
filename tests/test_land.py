"""Kinds, plot numbers, shapes, register readers, page details, enrichment and reports on inline cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plotlens.functions import parcels, shape
from plotlens.operators import enrichment, kinds, reports
from plotlens.operators import valuation as v
from plotlens.sources import details, registers
from plotlens.streaming import offers as streams


def every(spark, column, values, name="x"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")
    return [r.y for r in rows.select("i", column(F.col(name)).alias("y")).orderBy("i").collect()]


def test_kinds_of_zones_and_purposes(spark):
    zones = {"SJ": "mieszkaniowa", "SW": "mieszkaniowa", "SZ": "mieszkaniowa", "SU": "uslugowa", "SH": "uslugowa", "SP": "przemyslowa", " sp ": "przemyslowa", "SR": None, "SK": None, "": None, None: None}
    assert every(spark, kinds.of_zone, list(zones)) == list(zones.values())
    said = {
        "teren zabudowy mieszkaniowej jednorodzinnej z uslugami": "mieszkaniowa", "teren zabudowy uslugowej i mieszkaniowej": "uslugowa", "teren produkcyjno-uslugowy": "przemyslowa", "budowlana": "mieszkaniowa",
        "przemyslowa": "przemyslowa", "lesna": "lesna", "siedliskowa": "mieszkaniowa", "rolna": None, "rekreacyjna": None, "inwestycyjna": None, "teren zabudowy usługowej": "uslugowa", "działka leśna": "lesna",
        "planem zagospodarowania przestrzennego": None, "mpzp i przeznaczona pod zabudowę usługową": "uslugowa", "działka pod zabudowę": "mieszkaniowa", "MPZP o symbolu terenu MN1": "mieszkaniowa",
        "planem zagospodarowania 43 U/MN, MW": "mieszkaniowa", None: None,
    }
    assert every(spark, kinds.of_purpose, list(said)) == list(said.values())
    titles = {
        "Działka na sprzedaż, 1508 m² Smołdzino, Smołdziński Las": None, "Działka na sprzedaż, 926 m² Leśniewo, Kwiatowa": None, "Działka na sprzedaż, 570 m² Smolno, Leśna": None,
        "Działka budowlana 800 m², ul. Leśna": "mieszkaniowa", "Sprzedam teren leśny 3 ha": "lesna", "Dom, a działka pod magazyn": "przemyslowa", None: None,
    }
    assert every(spark, kinds.of_title, list(titles)) == list(titles.values())
    rows = spark.createDataFrame([(1, "SP", "budowlana", None), (2, None, "MPZP", "Działka budowlana 8 m"), (3, "SR", "rolna", None)], "i int, zone string, purpose string, title string")
    assert {r.i: (r.kind, r.kind_source) for r in kinds.with_kind(rows).collect()} == {1: ("przemyslowa", "plan_ogolny"), 2: ("mieszkaniowa", "ogloszenie"), 3: (None, None)}


def test_plot_numbers(spark):
    cases = {
        "Nieruchomosc przy ul. Sw. Huberta (Obreb 63, dzialka nr 129/3).": (["129/3"], "0063", None), "dzialka powstanie z podzialu dzialki nr 273": (["273"], None, None),
        "Sprzedam dzialke ewidencyjna nr 208/25 w obrebie Kielpino Gorne": (["208/25"], None, "Kielpino Gorne"), "Piekna dzialka 1200 m2 w spokojnej okolicy": ([], None, None),
        "Dzialka o powierzchni 850 metrow": ([], None, None), "Dzialki nr 12/3 oraz 12/4, razem 2400 m2": (["12/3", "12/4"], None, None), "Mozliwosci zabudowy (MPZP - plan nr 2219): dzialka objeta jest planem": ([], None, None),
        "<p>Sprzedam <strong>dzialke nr 45/2</strong> w obrebie 12</p>": (["45/2"], "0012", None), "": ([], None, None), None: ([], None, None), "Ladna dzialka nad jeziorem": ([], None, None),
    }
    got = every(spark, parcels.references, list(cases))
    assert [(r.numbers, r.precinct_no, r.precinct_name) for r in got] == list(cases.values())
    assert [r.sure for r in got] == [len(n) == 1 for n, _, _ in cases.values()]


def test_long_texts_without_a_plot_number_are_cheap(spark):
    """The context before a match is looked for at a number's word, not at each character: the length of a text counts once."""
    import time

    text = "Piekna okolica, cisza i spokoj. " * 4000
    rows = spark.createDataFrame([(text * 3 + "Sprzedam dzialke nr 45/2 w obrebie 12",)], "t string")
    rows.select(parcels.references(F.lit("dz. nr 1")).alias("r")).collect()
    began = time.time()
    assert rows.select(parcels.references(F.col("t")).alias("r")).first().r.numbers == ["45/2"]
    assert time.time() - began < 5


def test_shapes(spark):
    box = lambda w, d: [(468_000.0, 719_000.0), (468_000.0 + w, 719_000.0), (468_000.0 + w, 719_000.0 + d), (468_000.0, 719_000.0 + d), (468_000.0, 719_000.0)]
    bent = [(0.0, 0.0), (60.0, 0.0), (60.0, 10.0), (10.0, 10.0), (10.0, 60.0), (0.0, 60.0), (0.0, 0.0)]
    rows = [(0, box(30, 30), None), (1, box(10, 100), None), (2, box(12, 60), None), (3, box(25, 40), None), (4, bent, None), (5, box(30, 40), 24.0), (6, box(80, 20), 0.0), (7, None, 18.0), (8, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)], None)]
    df = spark.createDataFrame(rows, "i int, ring array<struct<e:double,n:double>>, front double").withColumn("rect", shape.rectangle("ring"))
    m = {r.i: r.m for r in df.select("i", shape.measures(F.col("ring"), F.col("rect"), F.col("front")).alias("m")).collect()}
    assert m[0].compactness == pytest.approx(math.pi / 4) and m[0].slenderness == pytest.approx(1.0)
    assert (m[1].front_m, m[1].length_m, m[1].slenderness, m[1].azimuth) == (pytest.approx(10), pytest.approx(100), pytest.approx(10), 0) and m[1].flags == ["narrow_front", "slender", "odd_shape"]
    assert "narrow_front" in m[2].flags and m[3].flags == [] and "odd_shape" in m[4].flags
    assert (m[5].front_m, m[5].front_source) == (24.0, "ogloszenie") and (m[6].front_source, m[6].azimuth) == ("geometria (proxy)", 90)
    assert (m[7].area_m2, m[7].front_m, m[7].front_source) == (None, 18.0, "ogloszenie") and m[8].area_m2 is None and m[0].fill == pytest.approx(1.0)


GML = "http://www.opengis.net/gml/3.2"
PARCELS = f"""<wfs:FeatureCollection xmlns:wfs="w" xmlns:ms="m" xmlns:gml="{GML}"><wfs:member><ms:dzialki><gml:boundedBy><gml:Envelope srsName="urn:ogc:def:crs:EPSG::2180"/></gml:boundedBy>
<ms:geom><gml:Polygon srsName="urn:ogc:def:crs:EPSG::2180"><gml:exterior><gml:LinearRing><gml:posList>0 100 10 100 10 120 0 120 0 100</gml:posList></gml:LinearRing></gml:exterior>
<gml:interior><gml:LinearRing><gml:posList>2 102 4 102 4 104 2 104 2 102</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></ms:geom>
<ms:ID_DZIALKI>226101_1.0091.81/23</ms:ID_DZIALKI><ms:NUMER_DZIALKI>81/23</ms:NUMER_DZIALKI><ms:DATA>2024-05-01Z</ms:DATA></ms:dzialki></wfs:member>
<wfs:member><ms:dzialki><ms:NUMER_DZIALKI>9</ms:NUMER_DZIALKI></ms:dzialki></wfs:member></wfs:FeatureCollection>"""
ACTS = f"""<wfs:FeatureCollection xmlns:wfs="w" xmlns:app="a" xmlns:gml="{GML}" xmlns:xlink="x"><wfs:member><app:AktPlanowaniaPrzestrzennego><app:idIIP><app:Identyfikator><app:przestrzenNazw>PL.ZIPPZP.2000/226101-MPZP</app:przestrzenNazw>
<app:lokalnyId>1A</app:lokalnyId></app:Identyfikator></app:idIIP><app:tytul>miejscowy plan A</app:tytul><app:obowiazujeOd>2024-07-11</app:obowiazujeOd><app:status xlink:href="http://x/legalForce"/>
<app:zasiegPrzestrzenny><gml:MultiSurface srsName="http://www.opengis.net/gml/srs/epsg.xml#2180"><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>464000 725000 465000 725000 465000 726000 464000 725000</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>
<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>1 2 3 2 3 4 1 2</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></app:zasiegPrzestrzenny></app:AktPlanowaniaPrzestrzennego></wfs:member>
<wfs:member><app:AktPlanowaniaPrzestrzennego><app:tytul>bez granic</app:tytul></app:AktPlanowaniaPrzestrzennego></wfs:member></wfs:FeatureCollection>"""


def test_parcels_from_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PARCELS)
    (r,) = registers.read_parcels(spark, str(tmp_path / "p.xml")).collect()
    assert (r.parcel_id, r.number, r.municipality, r.precinct, str(r.date)) == ("226101_1.0091.81/23", "81/23", "2261011", "226101_1.0091", "2024-05-01")
    assert len(r.polygons) == 1 and len(r.polygons[0]) == 2 and r.area_m2 == 196.0
    assert (r.polygons[0][0][0].e, r.polygons[0][0][0].n) == (100.0, 0.0)  # an urn gives northing first


def test_acts_from_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ACTS)
    out = {r.title: r for r in registers.read_acts(spark, str(tmp_path / "a.xml")).collect()}
    a, b = out["miejscowy plan A"], out["bez granic"]
    assert (a.act, a.municipality, str(a.since), a.in_force, len(a.polygons)) == ("1A", "226101", "2024-07-11", True, 2)
    assert (a.polygons[0][0][0].e, a.polygons[0][0][0].n) == (464_000.0, 725_000.0)  # a short name gives easting first
    assert (b.act, b.municipality, b.in_force, b.polygons) == ("", None, False, None)


def test_lookup_problems(spark, tmp_path):
    replies = {"ok": "1\na.b|Gdansk|x\nc.d|Sopot|y\n", "none": "-1 brak\n", "worse": "-2 blad\n", "what": "?\n", "bare": "0\n", "short": "0\na.b|x\n", "empty": "\n", "noid": "0\n|x|y\n"}
    for name, body in replies.items():
        (tmp_path / f"{name}.txt").write_text(body)
    out = {r.file.split(".")[0]: (r.problem, r.id) for r in registers.read_lookups(spark, str(tmp_path), ("id", "name", "region")).collect()}
    assert out == {"ok": (None, "a.b"), "what": ("unknown status", None), "bare": ("no row", None), "short": ("too few fields", None), "empty": ("empty", None), "noid": ("no id", None)}


def test_fields_and_regions(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<msGMLOutput><l_layer><l_feature><gml:boundedBy><gml:Box><gml:coordinates>1,2</gml:coordinates></gml:Box></gml:boundedBy><symbol>SJ</symbol><pusty> </pusty></l_feature><l_feature><x></x></l_feature></l_layer></msGMLOutput>")
    assert [r.fields for r in registers.read_fields(spark, str(tmp_path / "f.xml"), "l_feature").collect()] == [{"symbol": "SJ"}]
    (tmp_path / "r.json").write_text(json.dumps({"_note": "x", "22": {"nazwa": "pomorskie", "lat": [53.4, 55.0], "lon": [16.5, 19.8]}}))
    (r,) = registers.read_regions(spark, str(tmp_path / "r.json")).collect()
    assert (r.code, r.name) == ("22", "pomorskie") and 300_000 < r.e_min < 345_000 and 545_000 < r.e_max < 560_000 and 600_000 < r.n_min < r.n_max < 830_000


def test_import_counters(spark):
    rows = [("2261", "2024-01-01", "1/1", "wolnyRynek", 10, 5), ("2262", "2024-01-01", "1/1", "wolnyRynek", 10, 5), ("2261", None, "1/1", "wolnyRynek", 10, 5), ("2261", "2024-01-01", "1/2", "wolnyRynek", 10, 5)]
    df = spark.createDataFrame(rows, "teryt_powiat string, d string, udzial string, rodzaj_trans string, price_grosze bigint, area_m2 int").withColumn("sale_date", F.to_date("d"))
    kept, counts = registers.imported(df, ["2261"])
    assert kept.count() == 2 and tuple(counts.first()) == (4, 1, 1, 2, 1)


def test_details_of_three_layouts(spark):
    ad = {"title": "Teren", "slug": "dzialka-lipa-ID4Bjm4", "description": "<p>Cisza</p>", "location": {"coordinates": {"latitude": 54.1, "longitude": 18.2}}, "target": {"Type": ["building", "orchard"], "Media_types": ["gas", "fibre"], "Access_types": ["hard_surfaced"], "Price": "250000", "Area": "1115"}}
    product = {"@type": ["RealEstateListing"], "name": "Działka  Lipa", "geo": {"latitude": "54,2", "longitude": "18,3"}, "floorSize": {"value": "835.00m²"}, "datePosted": "2026-07-13CEST20:53:48Z", "additionalProperty": [{"name": "Land Area", "value": "900"}, {"name": "land dimensions", "value": "24m x 25m"}]}
    nuxt = [{"northeast": 1}, {"latitude": 5, "longitude": 5}, {"center": 3, "zoom": 0}, {"latitude": 4, "longitude": 5}, 54.3, 18.4]
    pages = {
        1: f'<script id="__NEXT_DATA__" type="x">{json.dumps({"props": {"pageProps": {"ad": ad}}})}</script>',
        2: f'<link rel="canonical" href="https://x/o,123456.html"><script type="application/ld+json">{json.dumps([product])}</script><strong>Forma własności:</strong> <i>własność</i>',
        3: f'<script type="application/ld+json">{json.dumps({"@type": "Offer", "name": "Działka, 1 204 m² Lipa", "price": "373240.00", "description": "Dojazd drogą gminną, droga gminna. MPZP: MN"})}</script><script id="__NUXT_DATA__">{json.dumps(nuxt)}</script>',
        4: "<html><title>Pusto</title></html>", 5: None,
    }
    out = {r.page_id: r for r in details.details(spark.createDataFrame(list(pages.items()), "page_id bigint, html string")).collect()}
    assert (out[1].offer_no, out[1].price_grosze, out[1].area_m2, out[1].purpose, out[1].utilities, out[1].access, out[1].lat) == ("ID4Bjm4", 25_000_000, 1115, "budowlana, orchard", {"gaz": True}, "hard_surfaced", 54.1)
    assert (out[2].offer_no, out[2].title, out[2].area_m2, out[2].front_m, str(out[2].updated), out[2].ownership, out[2].lat) == ("123456", "Działka Lipa", 900, 24.0, "2026-07-13", "własność", 54.2)
    assert (out[3].price_grosze, out[3].area_m2, out[3].lat, out[3].purpose) == (37_324_000, 1204, 54.3, "MPZP: MN") and out[3].access.startswith("Dojazd drogą gminną")
    assert (out[4].title, out[4].price_grosze, out[4].lat, out[4].source) == ("Pusto", None, None, "page") and out[5].title is None
    state = {r.page_id: r for r in details.as_state(spark.createDataFrame([(1,)], "page_id int").join(details.details(spark.createDataFrame(list(pages.items()), "page_id bigint, html string")), "page_id", "right")).collect()}
    assert state[3].e == pytest.approx(460_000, abs=5_000) and state[4].e is None and state[4].phone_sha256 is None


def test_coverage_and_areas(spark):
    rows = spark.createDataFrame([(1, ["planning", "parcel"], False), (2, ["planning", "parcel"], True), (3, [], False), (4, ["planning", "utilities", "terrain", "flood", "parcel"], False)], "i int, s array<string>, f boolean")
    assert {r.i: r.c for r in rows.select("i", enrichment.coverage(F.col("s"), F.col("f")).alias("c")).collect()} == {1: 0.542, 2: 0.47, 3: 0.0, 4: 1.0}
    areas = spark.createDataFrame([(1, 0, 500), (2, 700, 500), (3, None, None)], "i int, p int, a int")
    assert [r.x for r in areas.select("i", enrichment.capacity_area(F.col("p"), F.col("a")).alias("x")).orderBy("i").collect()] == [500.0, 700.0, None]


def test_health_line(spark):
    assert tuple(reports.health_line(spark.createDataFrame([], "weight string, problem string, subject string, n bigint")).first()) == (0, 0, "all well")
    rows = spark.createDataFrame([("alarm", "silent", "x", None), ("note", "source_error", "egib", 3)], "weight string, problem string, subject string, n bigint")
    assert reports.health_line(rows).first().text == "1 alarms, 1 notes\nalarm silent x\nnote source_error egib 3"


def test_curve_finds_its_bend(spark):
    rows = [("s", float(a), math.exp(1.0 + 0.9 * math.log(a) - 0.3 * max(0.0, math.log(a / 3000))) / a) for a in range(200, 9000, 20)] + [("thin", 500.0, 1.0)] * 50
    (r,) = v.fitted_curves(spark.createDataFrame(rows, "tx_segment string, tx_area double, tx_price_m2 double")).collect()
    assert (r.segment, r.knots) == ("s", [800.0, 3000.0]) and r.slope == pytest.approx(0.9, abs=1e-6) and r.deltas == pytest.approx([0.0, -0.3], abs=1e-6) and r.r2 == pytest.approx(1.0)


def test_stream_joins_and_windows(spark, tmp_path):
    from plotlens.plans.streams import run_to_end

    offers = spark.createDataFrame([("p1", "2024-01-01"), ("p2", "2024-01-01"), ("p1", "2024-09-01")], "parcel_ref string, t string").selectExpr("parcel_ref", "cast(t as timestamp) first_seen")
    sales = spark.createDataFrame([("p1", "2024-03-01"), ("p2", "2024-12-01"), ("p1", "2023-12-01")], "parcel_ref string, t string").selectExpr("parcel_ref", "cast(t as timestamp) sold_at")
    for name, df in (("o", offers), ("s", sales)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    joined = streams.sold_within(read("o", offers), read("s", sales)).selectExpr("a.parcel_ref", "a.first_seen", "b.sold_at")
    assert [(r.parcel_ref, str(r.sold_at)[:10]) for r in run_to_end(joined).collect()] == [("p1", "2024-03-01")]
    seen = spark.createDataFrame([("x", "2024-01-01"), ("x", "2024-01-03"), ("x", "2024-03-01")], "portal string, t string").selectExpr("portal", "cast(t as timestamp) ts")
    seen.coalesce(1).write.parquet(str(tmp_path / "w"))
    counts = streams.sliding_counts(read("w", seen)).selectExpr("w.start as start", "portal", "n")
    got = {str(r.start)[:10]: r.n for r in run_to_end(counts).collect()}
    assert got["2024-01-01"] == 2 and got["2023-12-31"] == 2 and got["2024-01-03"] == 1 and "2024-03-01" not in got
