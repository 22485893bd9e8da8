"""Hand-computed cases of the column functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from plotlens.functions import codes, dates, price, text
from plotlens.operators import calibration, changes, components, duplicates, grid, market, offers, quality, scoring, stats
from plotlens.operators import valuation as v


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(x).alias(k) for k, x in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1 250 000 zł", 125_000_000), ("1.250.000,50 PLN", 125_000_050), ("350000", 35_000_000), ("99,5", None), ("cena do negocjacji", None), (None, None), ("2 500,00", 250_000)],
)
def test_price(spark, raw, want):
    assert one(spark, text.price_grosze(F.col("r")), r=raw) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("1 115 m2", 1115), ("12 ar", 1200), ("0,5 ha", 5000), ("30 m2", None), ("dzialka", None), (None, None), ("15 arów", 1500), ("2 hektary", 20_000), ("Działka 1500 m2", 1500), ("1,5 ha", 15_000),
    ("15 a", 1500), ("1500", 1500), ("1 204 m²", 1204), ("3 mkw", None), ("9000000", None), ("12,5 ARY", 1250),
])
def test_area(spark, raw, want):
    assert one(spark, text.area_m2(F.col("r")), r=raw) == want


def test_text(spark):
    assert one(spark, text.fold(F.lit("Kąty Żółwin"))) == "Katy Zolwin"
    assert one(spark, text.tokens(F.lit("Działka budowlana, Kokoszki 1115 m2 (Kokoszki)"))) == ["1115", "budowlana", "kokoszki"]
    assert one(spark, text.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d")))) == 0.5
    assert one(spark, text.phone_hash(F.lit("+48 601-234-567"))) == one(spark, F.sha2(F.lit("601234567"), 256))
    assert one(spark, text.phone_hash(F.lit("12345"))) is None
    assert one(spark, text.image_key(F.lit("https://r.example/thumb/aHR0cHM6Ly94LmV4YW1wbGUvYS5qcGc_dz0x/300"))) == "https://x.example/a.jpg"
    assert one(spark, text.image_key(F.lit("https://x.example/b.jpg?w=2"))) == "https://x.example/b.jpg"
    assert [one(spark, text.local_symbol(F.lit(s))) for s in ("12MN/U", "mn", "ZL1", "", None)] == ["MNU", "MN", "ZL", None, None]
    assert [one(spark, text.indicator(F.lit(s))) for s in ("0,4", " 30 ", "-", "brak", "")] == [0.4, 30.0, None, None, None]
    assert one(spark, text.utilities(F.lit("prąd i wodociąg przy drodze"))) == {"prad": True, "woda": True}
    assert one(spark, text.utilities(F.lit("cisza"))) is None
    assert one(spark, text.frontage(F.lit("24m x 25,5m"))) == 24.0
    assert one(spark, text.frontage(F.lit("24 x 25"))) is None
    html = "<dt>Rodzaj działki:</dt><dd>rolna</dd><b>rodzaj działki: </b>x<strong>Forma własności:</strong> <i><b>pełna  własność</b></i><span>Dojazd:</span> <span>asfalt</span><b>Pusta:</b> <i></i>"
    assert one(spark, text.labels(F.lit(html))) == {"rodzaj dzialki": "rolna", "forma wlasnosci": "pełna własność", "dojazd": "asfalt"}
    assert one(spark, text.fold(F.lit("Ružomberok řš Ąß m²"))) == "Ruzomberok rs Aß m2"
    for said, found in (("przyłącze elektryczne", {"prad": True}), ("przyłącze wody", {"woda": True}), ("za wodami", None), ("gaz, kanalizacja", {"gaz": True, "kanalizacja": True})):
        assert one(spark, text.utilities(F.lit(said))) == found
    assert one(spark, text.utilities(F.lit("gaz, prąd, szambo"), text.LABEL_UTILITIES)) == {"prad": True, "gaz": True, "szambo": True}
    assert one(spark, text.planning_sentence(F.lit("Cisza."), F.lit("<p>Teren objęty MPZP jako <b>MN</b>. Las."))) == "MPZP jako MN"
    assert one(spark, text.road_access(F.lit("Szybki dojazd do centrum. Wjazd z drogi o nawierzchni asfaltowej. Media."))) == "Wjazd z drogi o nawierzchni asfaltowej"
    assert one(spark, text.road_access(F.lit("Szybki dojazd do centrum."))) is None
    same = one(spark, F.sha2(F.lit("601234567"), 256))
    assert [one(spark, text.phone_hash(F.lit(p))) == same for p in ("601234567", "48601234567", "0048601234567", "4860123456")] == [True, True, False, False]
    assert one(spark, text.phone_hash(F.lit("4812345678"))) == one(spark, F.sha2(F.lit("4812345678"), 256))
    assert [one(spark, text.area_in_title(F.lit(x))) for x in ("Działka, 1 204 m² Lipa", "Działka")] == [1204, None]
    assert one(spark, text.area_in_text(F.lit("od 1193 m2, o pow. ok. 1 250 m2"))) == 1250
    assert one(spark, text.area_in_page(F.lit('<title>Dom</title>"floorSize":{"value":"835.00"}'))) == 835
    assert one(spark, text.known_codes(F.array(F.lit("building"), F.lit("orchard")), text.PLOT_TYPES, True)) == ["budowlana", "orchard"]
    assert [one(spark, text.hash_bits(F.lit(x))) for x in ("101", "ff", "", None)] == [5, 255, None, None]
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in (("Land Area", "5"), ("", "x"), ("land area", " 7 "))])
    assert one(spark, text.properties(pairs)) == {"land area": "7"}
    assert one(spark, text.offer_number(F.lit("https://x.example/dzialka-lipa,123456.html"))) == "123456"
    land = lambda t, a: one(spark, text.looks_like_land(F.lit(t).cast("string"), F.lit(a).cast("int")))
    assert [land("Mieszkanie 3 pokoje", 900), land("Działka z halą", 900), land("Hala", 900), land("Garaz", 900), land(None, 900), land("Działka", None), land("Działka", 20)] == [False, True, False, True, True, False, False]


def test_dates(spark):
    assert str(one(spark, dates.iso_prefix(F.lit("2024-09-09T00:00:00+02")))) == "2024-09-09"
    assert one(spark, dates.iso_prefix(F.lit("wkrótce"))) is None
    assert str(one(spark, dates.long_polish(F.lit("Dodano 10 sierpnia 2026 r.")))) == "2026-08-10"
    assert str(one(spark, dates.slashed(F.lit("2026/08/10 12:00")))) == "2026-08-10"


def test_codes(spark):
    assert one(spark, codes.municipality(F.lit("226101_1.0091.81/23"))) == "2261011"
    assert one(spark, codes.precinct(F.lit("226101_1.0091.81/23"))) == "226101_1.0091"
    assert one(spark, codes.municipality(F.lit("x"))) is None
    assert one(spark, codes.parcel_id(F.lit("226101_1"), F.lit("91"), F.lit("81/23"))) == "226101_1.0091.81/23"
    seg = lambda a, b: one(spark, codes.segment(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert seg("budownictwoMieszkanioweJednorodzinne;terenZabudowyUslugowej", None) == "mieszkaniowa_jednorodzinna"
    assert seg("brakMPZPlubWZ", "grunty rolne") == "nieokreslona_rolna" and seg(None, None) == "nieokreslona"


def test_price_functions(spark):
    f = lambda c: one(spark, c)
    assert f(price.normalised(F.lit(200.0), F.lit(1000.0))) == pytest.approx(200)
    there = price.normalised(F.lit(123.0), F.lit(2500.0))
    assert f(price.denormalised(there, F.lit(2500.0))) == pytest.approx(123)
    bent = price.normalised(F.lit(100.0), F.lit(5000.0), 0.8, ((3000.0, -0.2),))
    assert f(bent) == pytest.approx(100 * math.exp(0.8 * math.log(1000) - 0.8 * math.log(5000) + 0.2 * math.log(5000 / 3000)) * 5)
    assert f(price.yearly_change(F.lit(100.0), F.lit(121.0), F.lit(2))) == pytest.approx(0.10)
    assert f(price.indexed(F.lit(100.0), F.lit(0.9), F.lit(1.0))) == pytest.approx(125)
    assert f(price.indexed(F.lit(100.0), F.lit(None).cast("double"), F.lit(1.0))) == pytest.approx(108)
    assert f(price.deviation(F.lit(90.0), F.lit(100.0))) == pytest.approx(-0.1) and f(price.deviation(F.lit(90.0), F.lit(0.0))) is None
    assert f(price.scaled(F.lit(20.0), 10, 30)) == 50.0 and f(price.scaled(F.lit(40.0), 0, 15, True)) == 0.0
    assert f(price.within(F.lit(1000), F.lit(1030), 0.03)) and not f(price.within(F.lit(0), F.lit(0), 0.03))
    assert f(price.deal_score(F.lit(80), F.lit(100), F.lit(0.2))) == pytest.approx(1.0)


def test_stats(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", 7.0)], "k string, x double")
    got = {r.k: (r.n, r.median, round(r.sigma, 4)) for r in stats.robust(df, ["k"], "x").collect()}
    assert got == {"a": (5, 3.0, 1.4826), "b": (2, 6.0, 1.4826)}
    assert sorted(r.x for r in stats.drop_outliers(df, ["k"], "x").collect()) == [1, 2, 3, 4, 5, 7]
    w = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 1.0), (1, 30.0, 2.0), (2, 5.0, 3.0)], "t int, v double, w double")
    assert {r.t: r.q for r in stats.weighted_quantile(w, ["t"], "v", "w", 0.5, "q").collect()} == {1: pytest.approx(20 + 10 * 0.125 / 0.375), 2: 5.0}
    s = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 2.0, 5.0), (1, 3.0, 9.0), (2, 1.0, 1.0), (2, 1.0, 2.0)], "g int, x double, y double")
    rho = {r.g: r.rho for r in stats.spearman(s, ["g"], "x", "y").collect()}
    assert rho[1] == pytest.approx(0.9486833) and math.isnan(rho[2])
    line = spark.createDataFrame([("q", float(i), 2.0 * i + (50 if i == 3 else 0)) for i in range(8)], "k string, x double, y double")
    assert stats.theil_sen(line, ["k"], "x", "y").first().slope == pytest.approx(2.0)


def test_grid(spark):
    a = spark.createDataFrame([(1, 499.0, 0.0), (2, 5000.0, 5000.0), (3, None, 1.0)], "id int, e double, n double")
    b = spark.createDataFrame([(10, 501.0, 0.0), (11, 9000.0, 5000.0)], "key int, e double, n double")
    assert [(r.id, r.key) for r in grid.within(a, b, 300.0).collect()] == [(1, 10)]
    assert sorted((r.id, r.key, r.dist_m) for r in grid.nearest(a, b, "id", "key", 100.0).collect()) == [(1, 10, 2.0), (2, 11, 4000.0)]
    dense = spark.createDataFrame([(float(i % 50), float(i // 50)) for i in range(400)] + [(60_000.0, 60_000.0)], "e double, n double")
    tiles = grid.tiles(dense, most=100, smallest=1000.0)
    assert sorted((r.size, r.n) for r in tiles.collect()) == [(1000.0, 400), (32_000.0, 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_market(spark):
    rows = [("gmina", "0101011", "s", y, m, n) for y, m, n in ((2000, 100.0, 10), (2002, 121.0, 20), (2003, 500.0, 3))] + [("gmina", "0101011", "wild", 2000, 10.0, 50), ("gmina", "0101011", "wild", 2001, 90.0, 50)]
    got = market.dynamics(spark.createDataFrame(rows, "level string, area string, segment string, year int, median double, n bigint")).first()
    assert got.cagr == pytest.approx(0.10) and (got.n_obs, got.year_from, got.year_to) == (10, 2000, 2002)
    areas = spark.createDataFrame([("gmina", "0101011", 0.2, 30), ("wojewodztwo", "01", 0.0, 500)], "level string, area string, cagr double, n_obs bigint")
    t = market.shrunk_dynamics(spark.createDataFrame([("0101011",), ("0199",), ("77",)], "municipality string"), areas)
    assert {r.municipality: r.cagr for r in t.collect()} == {"0101011": pytest.approx(0.1), "0199": pytest.approx(0.0), "77": None}


def test_shrunk_median(spark):
    rows = [(1, "gmina", p, 1000.0, "2026-08-21", "s", "s", 1) for p in (180.0, 200.0, 220.0)]
    comps = spark.createDataFrame(rows, "target_id int, level string, tx_price_m2 double, tx_area double, d string, segment string, tx_segment string, segments_used int")
    comps = comps.withColumn("tx_date", F.to_date("d")).withColumn("as_of", F.lit("2026-08-21").cast("date"))
    t = spark.createDataFrame([(1, 1000.0)], "target_id int, area_m2 double")
    out = v.shrunk_median(t, comps).first()
    assert out.value_grosze == 20_000_000 and out.unit_norm == pytest.approx(200) and out.level_used == "gmina" and out.method == "median_shrink/pary"
    assert out.sigma == pytest.approx(0.18 * math.sqrt(1 + 1 / 3) * 1.15)


def test_scoring(spark):
    base = dict(local_symbol=None, local_plan=None, general_plan=None, zone=None, infill=None, permit=None)
    cases = [
        (dict(local_symbol="12MN/U"), "A"), (dict(local_plan=True), "?"), (dict(general_plan=True, infill=True, zone="SN"), "D"), (dict(general_plan=True, infill=True), "B"),
        (dict(permit=True), "C"), (dict(general_plan=True, infill=False), "D"), (dict(general_plan=False), "E"), ({}, "?"),
    ]
    schema = "local_symbol string, local_plan boolean, general_plan boolean, zone string, infill boolean, permit boolean"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).coalesce(1)
    assert [r.status for r in scoring.planning_status(df).collect()] == [s for _, s in cases]
    cap = spark.createDataFrame([(1000.0, 0.4, 25.0, 9.0, 50.0, "SJ"), (1000.0, 2.5, 50.0, 17.0, 30.0, "SW"), (1000.0, None, None, None, None, None)], "area_m2 double, intensity double, footprint_pct double, height_m double, green_pct double, zone string").coalesce(1)
    assert [None if r.usable_m2 is None else round(r.usable_m2, 6) for r in scoring.capacity(cap).collect()] == [320.0, 1750.0, None]
    p = spark.createDataFrame([({"planning": 100.0, "location": None, "infrastructure": 50.0}, 0.5), ({"market": 80.0}, 1.0)], "pillars map<string,double>, multiplier double").coalesce(1)
    rows = scoring.composite(p).collect()
    assert rows[0].score == pytest.approx(round((0.35 * 100 + 0.18 * 50) / 0.53 * 0.5, 1)) and rows[0].coverage == 0.53 and rows[1].score is None


def test_weights_sum_to_one():
    for runs in (calibration.weight_runs(), calibration.random_runs()):
        assert all(sum(w.values()) == pytest.approx(1.0) for _, w in runs)
    assert calibration.random_runs() == calibration.random_runs()


def test_duplicates(spark):
    rows = [
        (1, "a", 0.0, 0.0, 1000, 300_000_00, "Działka budowlana Lipowa Osada", None), (2, "b", 10.0, 0.0, 1010, 301_000_00, "Lipowa Osada, budowlana okazja", None),
        (3, "a", 5.0, 0.0, 1020, 300_000_00, "Działka budowlana Lipowa Osada", None), (4, "c", 9000.0, 0.0, 500, 1_000_00, "Inna", "X1"), (5, "d", 0.0, 9000.0, 800, 2_000_00, "Inna druga", "X1"),
    ]
    df = spark.createDataFrame(rows, "offer_id bigint, portal string, e double, n double, area_m2 int, price_grosze bigint, title string, parcel_ref string").withColumn("parcel_sure", F.lit(True))
    listed = duplicates.prepared(df)
    scored, members = duplicates.find(listed)
    got = {(r.a, r.b): (r.certainty, r.stage, r.blocked) for r in scored.collect()}
    assert got == {(1, 2): (0.85, "title", False), (1, 3): (0.85, "title", True), (2, 3): (0.85, "title", False), (4, 5): (1.0, "plot", False)}
    assert {r.offer_id: r.cluster_id for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    top = {r.cluster_id: r for r in duplicates.summary(listed, members).collect()}
    assert top[1].canonical == 1 and top[1].portals == ["a", "b"] and top[1].members == 3


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, x int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, name string, x int")
    assert sorted(tuple(r) for r in changes.upsert(old, new, ["k"]).collect()) == [(1, "a", 1), (2, None, 5), (3, "c", 3)]
    assert sorted(tuple(r) for r in changes.upsert(old, new, ["k"], keep_known=True).collect()) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    assert [r.k for r in changes.insert_new(old, new.union(new), ["k"]).collect()] == [3]


def test_scrub(spark):
    f = lambda t, *spared: one(spark, quality.scrub(F.lit(t), spared))
    assert f("pisz a.b@x.example lub 601 234 567") == "pisz [email] lub [phone]"
    assert f("biuro@firma.pl i jan@dom.pl", "firma.pl") == "biuro@firma.pl i [email]"


def test_filter_rejects_unknown_keys():
    with pytest.raises(ValueError, match="colour"):
        offers.OfferFilter.of({"colour": "red"})
    assert offers.OfferFilter.of({"portals": ["a"]}).portals == ("a",)
