"""Enrichment, kinds, texts and pages: queries over layers and texts that the tables give, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.functions import codes, geo, parcels, shape, text
from plotlens.operators import enrichment as en
from plotlens.operators import kinds, reports
from plotlens.plans.views import OFFERS, TARGETS, TX, offers, plain, table, targets, transactions, view
from plotlens.session import dealt, staged
from plotlens.sources import details

#: Strips of land, one for each nation, as layers: acts, zones, infill, floods, local acts and networks.
STRIPS = """
SELECT n_nationkey AS k, 4000.0 * n_nationkey AS e0, 4000.0 * (n_nationkey + 1) AS e1, concat('plan-', cast(n_nationkey AS string)) AS act,
       CASE n_nationkey % 5 WHEN 0 THEN 'SJ' WHEN 1 THEN 'SU' WHEN 2 THEN 'SR' WHEN 3 THEN 'SW' ELSE 'SP' END AS zone,
       CASE WHEN n_nationkey % 2 = 0 THEN '9,5' ELSE '-' END AS height,
       CASE n_nationkey % 5 WHEN 0 THEN 'q10' WHEN 1 THEN 'q1' WHEN 2 THEN 'hWZ' WHEN 3 THEN 'q0_2' ELSE NULL END AS scenario,
       CASE n_nationkey % 4 WHEN 0 THEN 'power' WHEN 1 THEN 'water' WHEN 2 THEN 'sewer' ELSE 'gas' END AS medium, n_nationkey % 4 <> 0 AS in_force,
       4000.0 * n_nationkey + 100 AS along
FROM {nation}
"""
#: Plots around the valuation targets: a square of nearly the declared area, or of half of it.
PLOTTED = f"""
SELECT t.*, t.e + 5.0 * (t.target_id % 3) AS ce, sqrt(t.area_m2 * (CASE t.target_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.5 ELSE 1.02 END) + 0.123) / 2 AS half,
       CASE WHEN t.target_id % 8 = 2 THEN cast(20.0 AS double) ELSE NULL END AS listed_front FROM ({TARGETS}) t
"""


def _box(e0, n0, e1, n1):
    corner = lambda e, n: F.struct(F.lit(e).cast("double").alias("e") if not hasattr(e, "cast") else e.cast("double").alias("e"), F.lit(n).cast("double").alias("n") if not hasattr(n, "cast") else n.cast("double").alias("n"))
    return F.array(corner(e0, n0), corner(e1, n0), corner(e1, n1), corner(e0, n1), corner(e0, n0))


def _plotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PLOTTED)


def _outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _plotted(spark, sf_dir).select("target_id", "parcel_id", _box(c("ce") - c("half"), c("n") - c("half"), c("ce") + c("half"), c("n") + c("half")).alias("ring"))


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    strips, t, c = view(spark, sf_dir, STRIPS), _plotted(spark, sf_dir), F.col
    strip = lambda n0, n1: _box(c("e0"), n0, c("e1"), n1).alias("ring")
    fields = F.create_map(F.lit("maksWysokoscZabudowy"), c("height"), F.lit("maksNadziemnaIntensywnoscZabudowy"), F.lit("0,4"))
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    nodes = t.where("target_id % 7 <> 0").select("target_id", F.round(c("e") / 10).alias("x0"), F.round(c("n") / 10).alias("y0"), around.alias("d")).where("not (target_id % 5 = 0 and d.x = 1 and d.y = 1)")
    nodes = nodes.select(((c("x0") + c("d.x")) * 10).alias("e"), ((c("y0") + c("d.y")) * 10).alias("n"))
    line = F.array(F.struct(F.lit(0.0).alias("e"), c("along").cast("double").alias("n")), F.struct(F.lit(100_000.0).alias("e"), c("along").cast("double").alias("n")))
    return {
        "parcels": _outlined(spark, sf_dir).select("parcel_id", "ring"), "acts": strips.where("k < 15").select("act", strip(0, 100_000)),
        "zones": strips.select("zone", fields.alias("fields"), strip(0, 100_000)), "infill": strips.where("k % 2 = 0").select(strip(0, 50_000)),
        "floods": strips.where("scenario is not null").select("scenario", strip(20_000, 40_000)),
        "local_acts": strips.where("k % 6 = 0").select("act", "in_force", F.date_add(F.lit("2000-01-01").cast("date"), c("k").cast("int")).alias("since"), strip(60_000, 100_000)),
        "networks": strips.select("medium", line.alias("line")), "heights": nodes.select("e", "n", (0.03 * c("e") - 0.01 * c("n") + 100).alias("height")),
    }


def _enriched(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> DataFrame:
    asked = _plotted(spark, sf_dir).select(F.col("target_id").alias("offer_id"), "e", "n", F.col("area_m2").alias("declared_m2"), "listed_front")
    return staged(en.enriched(asked, {k: v for k, v in _sources(spark, sf_dir).items() if k not in without}), "enriched")


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all layers say about the valuation targets, and the coverage."""
    return _enriched(spark, sf_dir).select(
        "offer_id", F.array_join(F.array_sort("sources_ok"), ",").alias("sources"), "status", "local_plan", "local_act", "general_plan", "act", "zone", "infill", F.col("indicators.height_m").alias("height_limit"),
        F.array_join("floods", ",").alias("floods"), F.round("height", 6).alias("height"), F.round("slope", 6).alias("slope"), F.round("shape.front_m", 6).alias("front_m"), F.col("shape.front_source").alias("front_source"),
        F.element_at("buckets", F.lit("water")).alias("water"), "utility_cost", "parcel_id", "match", "parcel_area_m2", "coverage",
    )


def enrichment_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source counts of a run in which the flood and the height layers are missing."""
    rows = _enriched(spark, sf_dir, ("floods", "heights"))
    return reports.source_counts(rows, ["planning", "utilities", "parcel", "floods", "heights", "flood"])


def enrichment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.statistics(_enriched(spark, sf_dir))


def match_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.breakdown(_enriched(spark, sf_dir), "match", "unmatched")


def enrichment_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers to be enriched: those of an id divisible by 3 never were, every other one forty days ago."""
    rows = offers(spark, sf_dir)
    state = rows.where("offer_id % 3 <> 0").select("offer_id", F.when(F.col("offer_id") % 2 == 0, F.lit("2001-09-25")).otherwise(F.lit("2001-11-01")).cast("timestamp").alias("enriched_at"))
    return en.worklist(rows, state, F.lit("2001-11-04").cast("timestamp")).select("offer_id", "first_seen")


def stored_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched outlines merged into a table that holds a part of them with an older area, and how many offers link to each."""
    c = F.col
    state = _plotted(spark, sf_dir).select(c("target_id").alias("offer_id"), F.when(c("target_id") % 4 != 2, c("parcel_id")).alias("parcel_id"), _box(c("ce"), c("n"), c("ce") + c("half"), c("n") + c("half")).alias("ring"), F.floor(c("area_m2")).alias("parcel_area_m2"))
    old = _plotted(spark, sf_dir).where("target_id % 3 = 0").select("parcel_id", F.lit(None).cast("array<struct<e:double,n:double>>").alias("ring"), F.lit(1).alias("area_m2"), F.lit("old").alias("municipality"), F.lit(None).cast("string").alias("precinct"))
    stored = staged(en.store_parcels(old, state), "stored-parcels")
    links = en.linked(state, state, stored).groupBy("parcel_id").agg(F.count("*").alias("links"))
    return stored.join(links, "parcel_id", "left").select("parcel_id", c("ring").isNotNull().alias("outlined"), "area_m2", "municipality", "precinct", F.coalesce("links", F.lit(0)).alias("links"))


def parcel_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels turned by 30 degrees, 40 by 7 m times their half side: sides, slenderness and axis of the smallest rectangle."""
    c = F.col
    cos, sin = 0.75**0.5, 0.5
    corner = lambda x, y: F.struct((c("e") + c("half") * (x * cos - y * sin)).alias("e"), (c("n") + c("half") * (x * sin + y * cos)).alias("n"))
    ring = F.array(corner(0, 0), corner(40, 0), corner(40, 7), corner(20, 3.5), corner(0, 7), corner(0, 0))
    rows = _plotted(spark, sf_dir).select("target_id", "half", ring.alias("ring")).withColumn("rect", shape.rectangle("ring"))
    rows = rows.withColumn("m", shape.measures(F.col("ring"), F.col("rect"), F.lit(None).cast("double")))
    return rows.select("target_id", F.round("m.front_m", 4).alias("front_m"), F.round("m.length_m", 4).alias("length_m"), F.round("m.slenderness", 6).alias("slenderness"), "m.azimuth", F.round("m.fill", 6).alias("fill"), F.array_join("m.flags", ",").alias("flags"))


def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to degrees and back: how far they move."""
    t = targets(spark, sf_dir).select("target_id", (F.col("e") + 400_000).alias("e"), (F.col("n") + 400_000).alias("n")).withColumn("d", geo.to_wgs84(F.col("e"), F.col("n")))
    back = t.withColumn("b", geo.from_wgs84(F.col("d.lat"), F.col("d.lon")))
    return back.select("target_id", F.round(F.hypot(F.col("b.e") - F.col("e"), F.col("b.n") - F.col("n")), 2).alias("moved"), geo.plausible_degrees(F.col("d.lat"), F.col("d.lon")).alias("plausible"))


#: Texts of an advertisement around the values of an offer, in as many forms as people write.
ADS = f"""
SELECT o.*, o.price_grosze // 100 AS zloty, lpad(cast(o.offer_id % 1000000000 AS string), 9, '6') AS digits FROM ({OFFERS}) o
"""


def _ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, ADS.replace("//", "div")).withColumn("k", F.col("offer_id") % 5)
    k, z, a, d = F.col("k"), F.col("zloty"), F.col("area_m2"), F.col("digits")
    cost = F.when(k == 0, F.concat(z, F.lit(" zł"))).when(k == 1, F.concat(F.replace(F.format_number(z, 0), F.lit(","), F.lit(".")), F.lit(" PLN"))).when(k == 2, F.concat(F.lit("Cena: "), F.replace(F.format_number(z, 0), F.lit(","), F.lit(" ")), F.lit(" zł"))).when(k == 3, F.concat(z, F.lit(",50"))).otherwise(F.lit("zapytaj"))
    area = F.when(k == 0, F.concat(a, F.lit(" m2"))).when(k == 1, F.concat(F.lit("Działka "), a, F.lit(" mkw"))).when(k == 2, F.concat(F.floor(a / 100), F.lit(" arów"))).when(k == 3, F.concat(F.lit("ok. "), F.floor(a / 1000), F.lit(",5 ha"))).otherwise(a.cast("string"))
    phone = F.when(k == 0, F.concat(F.lit("+48 "), d)).when(k == 1, F.concat(F.lit("tel. "), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 3))).when(k == 2, F.substring(d, 1, 8)).when(k == 3, F.concat(F.lit("0048"), d)).otherwise(d)
    said = F.when(k == 0, "przyłącze elektryczne, gaz").when(k == 1, "WODOCIĄG i kanalizacja w drodze").when(k == 2, "za wodami, cisza").when(k == 3, "woda miejska; prąd").otherwise(F.lit(None))
    return rows.select("offer_id", cost.alias("cost"), area.alias("area"), phone.alias("phone"), said.alias("said"))


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, areas, phones and utilities read back from texts of many forms."""
    c = F.col
    return _ads(spark, sf_dir).select(
        "offer_id", text.price_grosze(c("cost")).alias("grosze"), text.area_m2(c("area")).alias("m2"), text.phone_hash(c("phone")).alias("phone"),
        F.array_join(F.array_sort(F.map_keys(text.utilities(c("said")))), ",").alias("utilities"), text.fold(F.concat(F.lit("Žółć Ružomberok m² "), c("offer_id"))).alias("folded"),
    )


def ad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details read back from pages that hold an offer as embedded data, with a map, labels or neither."""
    c = F.col
    rows = dealt(offers(spark, sf_dir), "offer_id").withColumn("k", c("offer_id") % 3)
    lat, lon = 54 + (c("offer_id") % 100) / 1000, 18 + (c("offer_id") % 70) / 1000
    name = F.concat(F.lit("Działka, "), F.coalesce(c("area_m2"), F.lit(0)), F.lit(" m² Lipa"))
    node = F.to_json(F.struct(F.lit("Offer").alias("@type"), F.concat(F.lit("https://x.example/dzialka-"), c("offer_id") + 10_000).alias("url"), name.alias("name"), F.concat(F.floor(c("price_grosze") / 100), F.lit(".00")).alias("price"), F.lit("<p>Teren objęty MPZP.</p><p>Prąd, gaz.</p>").alias("description")))
    state = F.concat(F.lit('[{"northeast":2},{"center":3,"zoom":5},{"latitude":5,"longitude":6},{"latitude":6,"longitude":7},0,12,'), lat.cast("string"), F.lit(","), lon.cast("string"), F.lit("]"))
    html = F.concat(
        F.lit("<html><head><title>Strona "), c("offer_id"), F.lit('</title><link rel="canonical" href="https://x.example/dzialka-'), c("offer_id") + 10_000, F.lit('"></head>'),
        F.when(c("k") < 2, F.concat(F.lit('<script type="application/ld+json">{"@graph":['), node, F.lit("]}</script>"))).otherwise(F.lit('<script type="application/ld+json">{broken</script>')),
        F.when(c("k") == 0, F.concat(F.lit('<script id="__NUXT_DATA__">'), state, F.lit("</script>"))).otherwise(F.lit("<b>Dojazd:</b> <i>asfalt</i><b>Media:</b> prąd, szambo")),
    )
    found = details.details(rows.select(c("offer_id").alias("page_id"), html.alias("html")))
    state_ = details.as_state(found)
    return found.join(state_.select("page_id", F.col("e").isNotNull().alias("placed")), "page_id").select(
        F.col("page_id").alias("offer_id"), "offer_no", "title", "price_grosze", "area_m2", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "placed", "purpose",
        F.array_join(F.array_sort(F.map_keys("utilities")), ",").alias("utilities"), "access", "source",
    )


def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = details.details(table(spark, sf_dir, "pages"))
    return found.select("page_id", "canonical", F.md5(F.coalesce("title", F.lit("")).cast("binary")).alias("title"), "price_grosze", "lat", "picture", "source")


def plot_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot numbers and precincts in texts: one number, a pair, an area that looks like one, and none."""
    c = F.col
    k, n = c("offer_id") % 4, F.concat((c("offer_id") % 900 + 1).cast("string"), F.lit("/"), (c("offer_id") % 30 + 1).cast("string"))
    said = F.when(k == 0, F.concat(F.lit("Sprzedam dzialka nr "), n, F.lit(" obręb 36."))).when(k == 1, F.concat(F.lit("dz. nr "), n, F.lit(" oraz 12/7, obręb Kiełpino Górne"))).when(k == 2, F.concat(F.lit("dzialka ma "), c("offer_id") % 900, F.lit(" m2, <b>dzialka 900 m2</b>"))).otherwise(F.lit(None).cast("string"))
    out = dealt(offers(spark, sf_dir).select("offer_id"), "offer_id").select("offer_id", parcels.references(said).alias("r"))
    return out.select("offer_id", F.array_join("r.numbers", " ").alias("numbers"), "r.precinct_no", "r.precinct_name", "r.sure")


#: Offers with what their kind and municipality are told from.
KINDED = f"""
SELECT o.offer_id, CASE o.offer_id % 10 WHEN 0 THEN 'SJ' WHEN 1 THEN 'su ' WHEN 2 THEN 'SR' ELSE NULL END AS zone,
       CASE o.offer_id % 7 WHEN 0 THEN 'teren zabudowy mieszkaniowej z usługami' WHEN 1 THEN 'pod zabudowę usługową' WHEN 2 THEN 'MPZP: 43 U/MN' ELSE NULL END AS purpose,
       CASE o.offer_id % 6 WHEN 0 THEN 'Działka leśna, 900 m2' WHEN 1 THEN 'Działka na sprzedaz, 570 m2 Smolno, Lesna' WHEN 2 THEN 'Hala i parcela z magazynem' WHEN 3 THEN 'Leśniewo, teren budowlany' ELSE NULL END AS title,
       CASE WHEN o.offer_id % 4 = 0 THEN concat('2261', lpad(cast(o.offer_id % 90 AS string), 2, '0'), '_1.0001.', cast(o.offer_id AS string)) ELSE NULL END AS parcel_id, o.e, o.n, o.active FROM ({OFFERS}) o
"""


def plot_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and municipality of the active offers, with the source of each."""
    sales = transactions(spark, sf_dir).select("tx_id", codes.municipality(F.col("parcel_id")).alias("municipality"), "e", "n")
    return kinds.assigned(view(spark, sf_dir, KINDED).where("active"), sales)


QUERIES = {
    f.__name__: f
    for f in (
        enrichment, enrichment_failures, enrichment_statistics, match_qualities, enrichment_worklist, stored_parcels, parcel_shapes, projected_points, text_values, ad_pages, page_details, plot_numbers, plot_kinds,
    )
}

_FIELDS = f"strips AS ({plain(STRIPS)}), t AS ({plain(PLOTTED)})"
_MATCH = f"""{_FIELDS},
cand AS (
  SELECT t.target_id AS offer_id, p.parcel_id, sqrt(pow(greatest(abs(t.e - p.ce) - p.half, 0), 2) + pow(greatest(abs(t.n - p.n) - p.half, 0), 2)) AS far, abs(t.e - p.ce) < p.half AND abs(t.n - p.n) < p.half AS inside,
         least(4 * p.half * p.half, t.area_m2) / greatest(4 * p.half * p.half, t.area_m2) AS ratio, floor(4 * p.half * p.half)::int AS area, 2 * p.half AS side
  FROM t JOIN t p ON abs(t.e - p.ce) <= p.half + 150 AND abs(t.n - p.n) <= p.half + 150),
ranked AS (
  SELECT *, CASE WHEN inside AND ratio >= 0.9 THEN 0 WHEN ratio >= 0.9 THEN 1 WHEN inside THEN 2 ELSE 3 END AS rank,
         row_number() OVER (PARTITION BY offer_id ORDER BY CASE WHEN inside AND ratio >= 0.9 THEN 0 WHEN ratio >= 0.9 THEN 1 WHEN inside THEN 2 ELSE 3 END, -ratio, far, parcel_id) AS k FROM cand WHERE far <= 250),
second AS (SELECT offer_id, far FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY -ratio, far, parcel_id) AS j FROM cand WHERE far <= 250 AND ratio >= 0.9) WHERE j = 2),
matched AS (
  SELECT r.offer_id, CASE WHEN rank < 3 THEN parcel_id END AS parcel_id, CASE WHEN rank = 0 THEN 'high' WHEN rank = 1 AND coalesce(abs(r.far - s.far) < 20, false) THEN 'low' WHEN rank = 1 THEN 'medium' WHEN rank = 2 THEN 'low' ELSE 'none' END AS match,
         CASE WHEN rank < 3 THEN area END AS area, side FROM ranked r LEFT JOIN second s USING (offer_id) WHERE k = 1),
zoned AS (
  SELECT t.*, (SELECT min(act) FROM strips WHERE k < 15 AND t.e BETWEEN e0 AND e1) AS gact, (SELECT min(zone) FROM strips WHERE t.e BETWEEN e0 AND e1) AS z,
         EXISTS (SELECT 1 FROM strips WHERE k % 2 = 0 AND t.e BETWEEN e0 AND e1 AND t.n BETWEEN 0 AND 50000) AS hit,
         (SELECT arg_max(act, (in_force, k)) FROM strips WHERE k % 6 = 0 AND t.e BETWEEN e0 AND e1 AND t.n BETWEEN 60000 AND 100000) AS lact,
         (SELECT list(DISTINCT scenario) FROM strips WHERE scenario IS NOT NULL AND t.e BETWEEN e0 AND e1 AND t.n BETWEEN 20000 AND 40000) AS fl,
         (SELECT min(height) FROM strips s WHERE t.e BETWEEN e0 AND e1 AND s.zone = (SELECT min(zone) FROM strips WHERE t.e BETWEEN e0 AND e1)) AS hl FROM t),
nodes AS (
  SELECT DISTINCT round(e / 10) + dx AS x, round(n / 10) + dy AS y FROM t, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE target_id % 7 <> 0 AND NOT (target_id % 5 = 0 AND dx = 1 AND dy = 1)),
land AS (SELECT target_id, count(*) AS held, count(*) FILTER (x = round(e / 10) AND y = round(n / 10)) AS own, any_value(0.3 * round(e / 10) - 0.1 * round(n / 10) + 100) AS h
         FROM t JOIN nodes ON abs(x - round(e / 10)) <= 1 AND abs(y - round(n / 10)) <= 1 GROUP BY 1),
near AS (SELECT target_id, medium, min(abs(n - along)) AS d FROM t, strips WHERE abs(n - along) <= 200 GROUP BY ALL),
net AS (
  SELECT target_id, max(CASE WHEN medium = 'power' THEN d END) p, max(CASE WHEN medium = 'water' THEN d END) w, max(CASE WHEN medium = 'sewer' THEN d END) s, max(CASE WHEN medium = 'gas' THEN d END) g FROM near GROUP BY 1),
out AS (
  SELECT z.target_id AS offer_id, m.parcel_id, m.match, m.area, coalesce(m.match IN ('high', 'medium'), false) AS usable, m.side, z.listed_front, z.gact, CASE WHEN gact IS NOT NULL THEN z END AS zone, CASE WHEN gact IS NOT NULL THEN hit END AS infill,
         z.lact, z.fl, CASE WHEN gact IS NOT NULL AND hl <> '-' THEN 9.5::double END AS limit_, l.held, coalesce(l.own, 0) AS own, l.h, net.target_id IS NOT NULL AS served, p, w, s, g
  FROM zoned z LEFT JOIN matched m ON m.offer_id = z.target_id LEFT JOIN land l USING (target_id) LEFT JOIN net USING (target_id)),
fin AS (
  SELECT *, CASE WHEN lact IS NOT NULL THEN '?' WHEN gact IS NOT NULL AND infill AND zone NOT IN ('SW', 'SJ', 'SZ', 'SU', 'SH', 'SP') THEN 'D' WHEN gact IS NOT NULL AND infill THEN 'B' WHEN gact IS NOT NULL THEN 'D' ELSE 'E' END AS status,
         coalesce(nullif(listed_front, 0), CASE WHEN usable THEN side END) AS front, NOT usable AND listed_front IS NOT NULL AS only_front FROM out)
"""
_COVER = "round_even(round((0.35 + CASE WHEN usable THEN 0.10 WHEN only_front THEN 0.04 ELSE 0 END + 0.10 + CASE WHEN own > 0 THEN 0.10 ELSE 0 END + CASE WHEN served THEN 0.18 ELSE 0 END)::double / 0.83, 9), 3)::double"
_KIND = """CASE offer_id % 10 WHEN 0 THEN 'mieszkaniowa' WHEN 1 THEN 'uslugowa' END"""
_SAID = """CASE offer_id % 7 WHEN 0 THEN 'mieszkaniowa' WHEN 1 THEN 'uslugowa' WHEN 2 THEN 'mieszkaniowa' ELSE CASE offer_id % 6 WHEN 0 THEN 'lesna' WHEN 2 THEN 'przemyslowa' WHEN 3 THEN 'mieszkaniowa' END END"""
SQL = {
    "enrichment": f"""WITH {_MATCH}
SELECT offer_id, array_to_string(list_sort(list_filter(['planning', CASE WHEN usable OR only_front THEN 'parcel' END, 'flood', CASE WHEN own > 0 THEN 'terrain' END, CASE WHEN served THEN 'utilities' END], lambda x: x IS NOT NULL)), ',') AS sources, status,
  lact IS NOT NULL AS local_plan, lact AS local_act, gact IS NOT NULL AS general_plan, gact AS act, zone, infill, limit_ AS height_limit,
  coalesce(array_to_string(list_filter(['q10', 'q1', 'hWZ', 'q0_2'], lambda x: list_contains(fl, x)), ','), '') AS floods, round(CASE WHEN own > 0 THEN h END, 6)::double AS height,
  CASE WHEN own > 0 AND held = 9 THEN round(100 * sqrt(0.03 * 0.03 + 0.01 * 0.01)::double, 6) END AS slope, round(front, 6) AS front_m,
  CASE WHEN listed_front IS NOT NULL THEN 'ogloszenie' WHEN front IS NOT NULL THEN 'geometria (proxy)' END AS front_source, CASE WHEN served THEN CASE WHEN w <= 50 THEN '<=50m' WHEN w <= 200 THEN '50-200m' ELSE '>200m' END END AS water,
  CASE WHEN served THEN CASE WHEN p <= 50 THEN 4500 WHEN p <= 200 THEN 11500 ELSE 25000 END + CASE WHEN w <= 50 THEN 8000 WHEN w <= 200 THEN 17500 ELSE 21000 END + CASE WHEN s <= 50 THEN 7500 WHEN s <= 200 THEN 17500 ELSE 16500 END
    + CASE WHEN g <= 50 THEN 5500 WHEN g <= 200 THEN 14000 ELSE 35000 END END AS utility_cost, parcel_id, match, area AS parcel_area_m2, {_COVER} AS coverage FROM fin""",
    "enrichment_failures": f"""WITH {_MATCH}, n AS (SELECT count(*) AS n, count(*) FILTER (served) AS served, count(*) FILTER (usable OR only_front) AS parcel FROM fin)
SELECT 'planning' AS source, n AS ok, 0 AS failed FROM n UNION ALL SELECT 'utilities', served, 0 FROM n UNION ALL SELECT 'parcel', parcel, 0 FROM n UNION ALL SELECT 'floods', 0, n FROM n UNION ALL SELECT 'heights', 0, n FROM n UNION ALL SELECT 'flood', 0, 0 FROM n""",
    "enrichment_statistics": f"WITH {_MATCH} SELECT count(*) AS processed, 0 AS failed, round(avg({_COVER}), 3) AS mean_coverage FROM fin",
    "match_qualities": f"WITH {_MATCH} SELECT coalesce(match, 'unmatched') AS value, count(*) AS n FROM fin GROUP BY 1",
    "enrichment_worklist": f"WITH o AS ({plain(OFFERS)}) SELECT offer_id, first_seen FROM o WHERE active AND (offer_id % 3 = 0 OR offer_id % 2 = 0)",
    "stored_parcels": f"""WITH t AS ({plain(PLOTTED)}), m AS (SELECT parcel_id, count(*) AS links, max(floor(area_m2)::int) AS area FROM t WHERE target_id % 4 <> 2 GROUP BY 1), o AS (SELECT DISTINCT parcel_id FROM t WHERE target_id % 3 = 0)
SELECT parcel_id, m.parcel_id IS NOT NULL AS outlined, coalesce(m.area, 1) AS area_m2, CASE WHEN m.parcel_id IS NOT NULL THEN substr(parcel_id, 1, 6) || substr(parcel_id, 8, 1) ELSE 'old' END AS municipality,
  CASE WHEN m.parcel_id IS NOT NULL THEN split_part(parcel_id, '.', 1) || '.' || split_part(parcel_id, '.', 2) END AS precinct, coalesce(links, 0) AS links FROM m FULL JOIN o USING (parcel_id)""",
    "parcel_shapes": f"""WITH t AS ({plain(PLOTTED)}) SELECT target_id, round(7 * half, 4) AS front_m, round(40 * half, 4) AS length_m, round(40 / 7.0::double, 6) AS slenderness, 60 AS azimuth, 0.75::double AS fill,
  array_to_string(list_filter([CASE WHEN 7 * half < 18 THEN 'narrow_front' END, 'slender', CASE WHEN 4 * pi() * 0.75 * 280 / pow(40 + 14 + 2 * sqrt(412.25), 2) < 0.45 THEN 'odd_shape' END], lambda x: x IS NOT NULL), ',') AS flags FROM t""",
    "projected_points": f"WITH t AS ({plain(TARGETS)}) SELECT target_id, 0.0::double AS moved, true AS plausible FROM t",
    "text_values": f"""WITH o AS ({plain(ADS)}), k AS (SELECT *, offer_id % 5 AS k FROM o),
v AS (SELECT *, CASE WHEN k < 3 THEN zloty * 100 WHEN k = 3 THEN zloty * 100 + 50 END AS g, CASE k WHEN 2 THEN floor(area_m2 / 100) * 100 WHEN 3 THEN floor(area_m2 / 1000) * 10000 + 5000 ELSE area_m2 END::bigint AS m FROM k)
SELECT offer_id, CASE WHEN g BETWEEN 10000 AND 50000000000 THEN g END AS grosze, CASE WHEN m BETWEEN 50 AND 5000000 THEN m END AS m2, CASE k WHEN 2 THEN NULL WHEN 3 THEN sha256('0048' || digits) ELSE sha256(digits) END AS phone,
  CASE k WHEN 0 THEN 'gaz,prad' WHEN 1 THEN 'kanalizacja,woda' WHEN 3 THEN 'prad,woda' END AS utilities, 'Zolc Ruzomberok m2 ' || offer_id AS folded FROM v""",
    "ad_pages": f"""WITH o AS (SELECT *, offer_id % 3 AS k FROM ({plain(OFFERS)}))
SELECT offer_id, (offer_id + 10000)::varchar AS offer_no, CASE WHEN k < 2 THEN 'Działka, ' || coalesce(area_m2, 0) || ' m² Lipa' ELSE 'Strona ' || offer_id END AS title, CASE WHEN k < 2 THEN price_grosze // 100 * 100 END AS price_grosze,
  CASE WHEN k < 2 THEN coalesce(area_m2, 0) END AS area_m2, CASE WHEN k = 0 THEN round((54 + offer_id % 100 / 1000.0)::double, 6) END AS lat, CASE WHEN k = 0 THEN round((18 + offer_id % 70 / 1000.0)::double, 6) END AS lon, k = 0 AS placed,
  CASE WHEN k < 2 THEN 'MPZP' END AS purpose, CASE k WHEN 0 THEN 'gaz,prad' ELSE 'prad,szambo' END AS utilities, CASE WHEN k > 0 THEN 'asfalt' END AS access, CASE WHEN k < 2 THEN 'text' ELSE 'page' END AS source FROM o""",
    "page_details": r"""SELECT page_id, nullif(regexp_extract(html, '<link[^>]+rel="canonical"[^>]+href="([^"]+)"', 1), '') AS canonical, md5(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'))) AS title,
  NULL::bigint AS price_grosze, NULL::double AS lat, nullif(regexp_extract(html, '<meta[^>]+property="og:image"[^>]+content="([^"]+)"', 1), '') AS picture, 'page' AS source FROM pages""",
    "plot_numbers": f"""WITH o AS (SELECT offer_id, offer_id % 4 AS k, (offer_id % 900 + 1) || '/' || (offer_id % 30 + 1) AS n FROM ({plain(OFFERS)}))
SELECT offer_id, CASE k WHEN 0 THEN n WHEN 1 THEN CASE WHEN n = '12/7' THEN n ELSE n || ' 12/7' END ELSE '' END AS numbers, CASE WHEN k = 0 THEN '0036' END AS precinct_no, CASE WHEN k = 1 THEN 'Kiełpino Górne' END AS precinct_name,
  k = 0 OR (k = 1 AND n = '12/7') AS sure FROM o""",
    "plot_kinds": f"""WITH tx AS ({plain(TX)}), o AS ({plain(KINDED)}), spots AS (SELECT e, n, min(tx_id) AS tx_id FROM tx GROUP BY ALL), places AS (SELECT DISTINCT e, n FROM o WHERE active AND parcel_id IS NULL),
best AS (SELECT p.e, p.n, min((sqrt((p.e - s.e) * (p.e - s.e) + (p.n - s.n) * (p.n - s.n)), s.tx_id)) AS b FROM places p, spots s GROUP BY ALL),
near AS (SELECT best.e, best.n, substr(t.parcel_id, 1, 6) || substr(t.parcel_id, 8, 1) AS m FROM best JOIN (SELECT DISTINCT tx_id, parcel_id FROM tx) t ON t.tx_id = b[2])
SELECT offer_id, coalesce({_KIND}, {_SAID}) AS kind, CASE WHEN {_KIND} IS NOT NULL THEN 'plan_ogolny' WHEN {_SAID} IS NOT NULL THEN 'ogloszenie' END AS kind_source,
  CASE WHEN o.parcel_id IS NOT NULL THEN substr(o.parcel_id, 1, 6) || substr(o.parcel_id, 8, 1) ELSE near.m END AS municipality, CASE WHEN o.parcel_id IS NOT NULL THEN 'dzialka' WHEN near.m IS NOT NULL THEN 'rcn' END AS municipality_source
FROM o LEFT JOIN near ON near.e = o.e AND near.n = o.n AND o.parcel_id IS NULL WHERE active""",
}
