"""Cards, saved offers, tables and reports over the views, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.functions import price
from plotlens.operators import calibration, cards, duplicates, market, reports
from plotlens.operators import valuation as value
from plotlens.plans import duplicates as duplicate_plans
from plotlens.plans import market as market_plans
from plotlens.plans import scoring as scoring_plans
from plotlens.plans import surfaces
from plotlens.plans import valuation as value_plans
from plotlens.plans.views import AS_OF, OFFERS, offers, plain, table, view
from plotlens.session import shared_folder, staged

LAST = surfaces.LAST
#: Names of counties and of every other municipality.
NAMES = """
SELECT concat(lpad(cast(2 * n_regionkey + 2 AS string), 2, '0'), lpad(cast(n_nationkey + 1 AS string), 2, '0')) AS code, n_name AS name FROM {nation} UNION ALL
SELECT concat(lpad(cast(2 * n_regionkey + 2 AS string), 2, '0'), lpad(cast(n_nationkey + 1 AS string), 2, '0'), '021'), concat(n_name, ' II') FROM {nation}
"""
#: Prices that offers had: up to three, each a tenth below the one before.
HISTORY = f"""
SELECT o.offer_id, k.k, cast(o.price_grosze * (10 - k.k) AS bigint) // 10 AS price_grosze FROM ({OFFERS}) o CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE k.k <= o.offer_id % 3
"""
#: A measurement log out of the events.
LOG = """
SELECT 'spread' AS kind, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS segment, value, user_id % 60 AS n_obs, 'events' AS source, ts AS computed_at, event_id FROM {events}
"""


def offer_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the second saved filter as it is shown, with the total of the list."""
    page = cards.page_with_total(surfaces._star(spark, sf_dir), surfaces.FILTERS[2], "unit_price", 50)
    rows = cards.with_names(page, view(spark, sf_dir, NAMES), "municipality", "municipality_name")
    return cards.display_row(rows).join(page.select("offer_id", "total"), "offer_id").select("offer_id", "portal", "price.zloty", "area_m2", "place.municipality_name", "total")


def offer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the offers of an id divisible by 8: history, duplicates and dynamics, told by their ends."""
    listed = offers(spark, sf_dir).where("active")
    prepared = duplicate_plans._offers(spark, sf_dir)
    others = cards.cheapest_duplicates(listed.where("offer_id % 8 = 0"), listed, staged(duplicates.members(prepared), "members"), prepared)
    areas = staged(market.dynamics(market.yearly_medians(market_plans._sales(spark, sf_dir))), "dynamics")
    history = view(spark, sf_dir, HISTORY.replace("//", "div")).withColumnRenamed("k", "at")
    asked = listed.where("offer_id % 8 = 0").select("offer_id")
    out = cards.offer_cards(asked, listed, history, others, areas)
    first = F.get("history", F.lit(0))
    return out.select(
        "offer_id", F.size("history").alias("prices"), first["zloty"].alias("first_zloty"), F.element_at("history", -1)["zloty"].alias("last_zloty"), F.coalesce(F.col("copies"), F.lit(0)).cast("int").alias("copies"),
        "cheapest", "certainty", F.col("dynamics.cagr").alias("cagr"), F.col("dynamics.level").alias("level"),
    )


def saved_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = offers(spark, sf_dir)
    saved = listed.where("offer_id % 7 = 0").select((F.col("offer_id") % 3).alias("user"), "offer_id")
    twice = F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("maybe").alias("verdict")), F.struct(F.lit(2).alias("at"), F.lit("yes").alias("verdict"))))
    feedback = listed.where("offer_id % 14 = 0").select((F.col("offer_id") % 3).alias("user"), "offer_id", twice.alias("f")).select("user", "offer_id", "f.*").where("not (offer_id % 28 = 0 and at = 2)")
    return cards.saved_offers(saved, listed.where("active").select("offer_id", "portal"), feedback)


def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = spark.createDataFrame([(i,) for i in (0, 1, 2, 9)], "filter_id bigint")
    return cards.saved_filters(filters, offers(spark, sf_dir).select((F.col("offer_id") % 3).alias("filter_id"), "offer_id"))


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty municipalities of the strongest rise, with names where there are any."""
    sales = market_plans.sales_once(spark, sf_dir)
    medians = staged(market.medians(market_plans.recent(sales), AS_OF), "medians")
    change = market.dynamics(market.yearly_medians(sales))
    return cards.price_table(medians, view(spark, sf_dir, NAMES), change, offers(spark, sf_dir), "gmina", order="change", limit=20).withColumn("cagr", F.round("cagr", 8))


def unnamed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.areas_without_name(market_plans.market_medians(spark, sf_dir), offers(spark, sf_dir), view(spark, sf_dir, NAMES))


def largest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = duplicate_plans._offers(spark, sf_dir)
    members = staged(duplicates.members(listed), "members")
    return cards.largest_clusters(duplicates.summary(listed, members), members, 15).select("cluster_id", "members", F.array_join("offers", " ").alias("offers"))


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = duplicate_plans._offers(spark, sf_dir)
    out = cards.pairs_for_review(duplicates.scored_alike(listed), listed)
    return out.select("a", "b", "certainty", F.col("a_offer.portal").alias("a_portal"), F.col("b_offer.price_grosze").alias("b_price"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LOG).withColumn("computed_at", F.col("computed_at").cast("timestamp"))


def usable_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread that counts for each segment: its own latest one, else that of all; zero if it rests on too little."""
    asked = spark.createDataFrame([(s,) for s in ("view", "error", "never")], "segment string")
    out = reports.current(_log(spark, sf_dir), asked, "spread")
    family = F.when(F.col("segment") == "view", "budowlana").when(F.col("segment") == "error", "rolna")
    return out.select("segment", F.round("value", 9).alias("value"), "n_obs", "own", F.round(reports.usable_spread(F.col("value"), F.col("n_obs")), 9).alias("used"), reports.expected(F.col("value"), family).alias("expected"))


def log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).withColumn("source", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return reports.log_history(rows, 25).select("segment", "value", "n_obs", "source")


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring_plans._scored(spark, sf_dir).withColumn("deal", F.when(F.col("offer_id") % 3 == 0, F.col("score") / 10 - 3))


def calibration_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of all measurements, appended to a new log and read from it."""
    valued = value_plans._model_1(spark, sf_dir).select("segment", F.col("asking_grosze").alias("price_grosze"), "value_grosze")
    rows = reports.calibration_run(valued, value.fitted_slopes(value_plans._sales(spark, sf_dir)), scoring_plans._scored(spark, sf_dir), "offer_id", F.lit(AS_OF))
    path = f"{shared_folder(spark).rstrip('/')}/plotlens-log-{uuid.uuid4().hex}"
    reports.append_log(path, rows)
    return spark.read.schema(rows.schema).parquet(path).select("kind", "segment", F.round("value", 6).alias("value"), "n_obs", "source")


def sensitivity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.sensitivity_verdict(scoring_plans._scored(spark, sf_dir), "offer_id")


def _state(scored: DataFrame) -> DataFrame:
    answers = F.array_compact(F.array(F.lit("planning"), F.when(F.col("offer_id") % 2 == 0, F.lit("flood")), F.when(F.col("offer_id") % 5 == 0, F.lit("terrain"))))
    errors = F.array_compact(F.array(F.when(F.col("offer_id") % 4 == 0, F.lit("egib: timeout")), F.when(F.col("offer_id") % 6 == 0, F.concat(F.lit("nmt: code "), (F.col("offer_id") % 12).cast("string")))))
    return scored.select("offer_id", F.when(F.col("offer_id") % 9 != 0, F.col("status")).alias("status"), answers.alias("sources_ok"), errors.alias("errors"))


def method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = staged(_deals(spark, sf_dir), "deals")
    return reports.method_report(scored, _state(scored), _log(spark, sf_dir)).withColumn("value", F.round("value", 6))


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_counts(_state(scoring_plans._scored(spark, sf_dir)), ["planning", "flood", "egib", "nmt", "silent"])


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems as one line each: a source that went silent, one that is absent, offers without a point, frequent errors."""
    events = table(spark, sf_dir, "events").where("not (event_type = 'error' and ts > timestamp '2024-01-20 00:00:00')")
    known = spark.createDataFrame([(x,) for x in ("click", "view", "error", "never")], "event_type string")
    listed = offers(spark, sf_dir).withColumn("e", F.when(F.col("offer_id") % 5 < 3, F.lit(None)).otherwise(F.col("e")))
    found = reports.health(events, known, listed, _state(scoring_plans._scored(spark, sf_dir)), "event_type", "ts", F.lit(LAST).cast("timestamp"), 5)
    return reports.health_line(found).select("alarms", "notes", F.md5(F.col("text").cast("binary")).alias("text"))


def dynamics_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dynamics_status(market.dynamics(market.yearly_medians(market_plans._sales(spark, sf_dir))))


def curve_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices normalised by a curve with bends and brought back, and the elasticity at each area."""
    bends = ((800.0, -0.1), (3000.0, -0.2))
    rows = value_plans._sales(spark, sf_dir)
    norm = price.normalised(F.col("tx_price_m2"), F.col("tx_area"), 0.8, bends)
    back = price.denormalised(norm, F.col("tx_area"), 0.8, bends)
    return rows.groupBy(F.round(price.local_elasticity(F.col("tx_area"), 0.8, bends), 6).alias("elasticity")).agg(F.count("*").alias("n"), F.round(F.max(F.abs(back / F.col("tx_price_m2") - 1)), 9).alias("off"))


QUERIES = {
    f.__name__: f
    for f in (
        offer_page_total, offer_cards, saved_offers, saved_filters, price_table, unnamed_areas, largest_clusters, review_pairs, usable_spreads, log_history, calibration_run, sensitivity_verdict, method_report,
        source_report, health_report, dynamics_status, curve_round_trip,
    )
}

_O = f"offers AS ({plain(OFFERS)})"
_MED = f"{market_plans.SALES}, {market_plans._medians('0.08::double')}, {_O}, names AS ({plain(NAMES)})"
_STATUS = scoring_plans._SCORED
_LOGGED = f"log AS ({plain(LOG)})"
_NEWEST = f"{_LOGGED}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY computed_at DESC, value DESC) AS k FROM log) WHERE k = 1)"
_PILLARS = ("planning", "location", "infrastructure", "physical", "risk", "market", "capacity")
SQL = {
    "offer_page_total": f"""{surfaces._STAR}, names AS ({plain(NAMES)}), paged AS (SELECT *, count(*) OVER () AS total, price_grosze / 100.0::double / area_m2 AS unit FROM f2 ORDER BY price_grosze / 100.0::double / area_m2 NULLS LAST, offer_id LIMIT 50)
SELECT offer_id, portal, price_grosze // 100 AS zloty, area_m2, name AS municipality_name, total FROM paged LEFT JOIN names ON code = municipality""",
    "offer_cards": f"""WITH RECURSIVE {duplicate_plans._MEMBERS}, h AS ({plain(HISTORY)}), {market_plans.SALES},
hist AS (SELECT offer_id, count(*) AS prices, arg_min(price_grosze, k) // 100 AS first_zloty, arg_max(price_grosze, k) // 100 AS last_zloty FROM h GROUP BY 1),
d AS (
  SELECT m.offer_id, o.offer_id AS other, s.certainty, row_number() OVER (PARTITION BY m.offer_id ORDER BY l.price_grosze, o.offer_id) AS j, count(*) OVER (PARTITION BY m.offer_id) AS copies
  FROM members m JOIN members o ON o.cluster_id = m.cluster_id AND o.offer_id <> m.offer_id JOIN listed l ON l.offer_id = o.offer_id LEFT JOIN scored s ON s.a = least(m.offer_id, o.offer_id) AND s.b = greatest(m.offer_id, o.offer_id)),
a AS (
  SELECT f.offer_id, g.cagr gc, g.n_obs gn, p.cagr pc, p.n_obs pn, w.cagr wc FROM offers f LEFT JOIN dynamics g ON g.level = 'gmina' AND g.area = f.municipality
  LEFT JOIN dynamics p ON p.level = 'powiat' AND p.area = substr(f.municipality, 1, 4) LEFT JOIN dynamics w ON w.level = 'wojewodztwo' AND w.area = substr(f.municipality, 1, 2) WHERE f.active AND f.offer_id % 8 = 0),
b AS (SELECT *, CASE WHEN pc IS NULL THEN wc WHEN wc IS NULL THEN pc ELSE pn / (pn + 30.0::double) * pc + (1 - pn / (pn + 30.0::double)) * wc END AS up FROM a)
SELECT b.offer_id, prices::int AS prices, first_zloty, last_zloty, coalesce(copies, 0)::int AS copies, other AS cheapest, certainty,
  round(CASE WHEN gc IS NULL THEN up WHEN up IS NULL THEN gc ELSE gn / (gn + 30.0::double) * gc + (1 - gn / (gn + 30.0::double)) * up END, 4) AS cagr,
  CASE WHEN gc IS NOT NULL THEN 'gmina' WHEN pc IS NOT NULL THEN 'powiat' WHEN wc IS NOT NULL THEN 'wojewodztwo' END AS level
FROM b JOIN hist USING (offer_id) LEFT JOIN d ON d.offer_id = b.offer_id AND j = 1""",
    "saved_offers": f"""WITH {_O} SELECT offer_id % 3 AS user, offer_id, CASE WHEN active THEN portal END AS portal, CASE WHEN offer_id % 28 = 0 THEN 'maybe' WHEN offer_id % 14 = 0 THEN 'yes' END AS verdict FROM offers WHERE offer_id % 7 = 0""",
    "saved_filters": f"WITH {_O} SELECT f.filter_id, count(o.offer_id) AS sent FROM (SELECT unnest([0, 1, 2, 9])::bigint AS filter_id) f LEFT JOIN offers o ON o.offer_id % 3 = f.filter_id GROUP BY 1",
    "price_table": f"""WITH {_MED}, listed AS (SELECT municipality AS area, count(*) AS offers FROM offers WHERE active GROUP BY 1)
SELECT area, coalesce(name, area) AS name, m.n, median_norm, p25_norm, p75_norm, round(cagr, 8) AS cagr, coalesce(l.offers, 0) AS offers FROM medians m LEFT JOIN (SELECT area, cagr FROM dynamics WHERE level = 'gmina') d USING (area)
LEFT JOIN listed l USING (area) LEFT JOIN names ON code = area WHERE level = 'gmina' AND segment = '*' AND m.n >= 10 ORDER BY cagr DESC NULLS LAST, area LIMIT 20""",
    "unnamed_areas": f"WITH {_MED} SELECT code FROM (SELECT area AS code FROM medians WHERE level = 'gmina' UNION SELECT municipality FROM offers WHERE active) WHERE code NOT IN (SELECT code FROM names)",
    "largest_clusters": f"WITH RECURSIVE {duplicate_plans._MEMBERS} SELECT cluster_id, count(*) AS members, string_agg(offer_id, ' ' ORDER BY offer_id) AS offers FROM members GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "review_pairs": f"""WITH {duplicate_plans._PAIRS}, r AS (SELECT * FROM scored WHERE (certainty < 0.7 OR blocked) AND certainty >= 0.5 ORDER BY certainty DESC, a, b LIMIT 50)
SELECT a, b, certainty, x.portal AS a_portal, y.price_grosze AS b_price FROM r JOIN listed x ON x.offer_id = a JOIN listed y ON y.offer_id = b""",
    "usable_spreads": f"""WITH {_NEWEST}, a AS (SELECT s.segment, coalesce(o.value, w.value) AS value, coalesce(o.n_obs, w.n_obs) AS n_obs, o.value IS NOT NULL AS own
  FROM (SELECT unnest(['view', 'error', 'never']) AS segment) s LEFT JOIN newest o USING (segment) LEFT JOIN newest w ON w.segment IS NULL)
SELECT segment, round(value, 9) AS value, n_obs, own, round(CASE WHEN n_obs >= 30 THEN value ELSE 0 END, 9) AS used, CASE segment WHEN 'view' THEN value BETWEEN 0.12 AND 0.2 WHEN 'error' THEN value BETWEEN 0.2 AND 0.35 END AS expected FROM a""",
    "log_history": f"WITH {_LOGGED} SELECT segment, value, n_obs, lpad(event_id::varchar, 12, '0') AS source FROM log ORDER BY computed_at DESC, kind, segment NULLS FIRST, 4 LIMIT 25",
    "calibration_run": f"""SELECT 'spread' AS kind, nullif(segment, '*') AS segment, spread AS value, n AS n_obs, 'oferty' AS source FROM ({scoring_plans.SQL['asking_spread']}) UNION ALL
SELECT 'beta1', segment, round(slope, 6), n, 'rcn' FROM ({value_plans.SQL['fitted_slopes']}) UNION ALL
SELECT 'wagi', NULL, round(median(overlap), 6), count(*), 'perturbacja' FROM ({scoring_plans.SQL['random_weight_sensitivity']}) UNION ALL
SELECT 'wrazliwosc', NULL, max(leaving), count(*), 'filar_pm20' FROM ({scoring_plans.SQL['weight_sensitivity']}) UNION ALL
SELECT 'dyskryminacja', NULL, round(fullest_share, 6), n, 'scores' FROM ({scoring_plans.SQL['score_discrimination']})""",
    "sensitivity_verdict": f"""WITH w AS ({scoring_plans.SQL['weight_sensitivity']}), {_STATUS}, base AS (SELECT offer_id, {scoring_plans._score(scoring_plans.s.WEIGHTS['retail'], False)[0]} AS score, {', '.join(_PILLARS[:6])} FROM gates),
top AS (SELECT * FROM base WHERE score IS NOT NULL ORDER BY score DESC, offer_id LIMIT 10)
SELECT (SELECT count(score) FROM base) AS n, (SELECT max(leaving) FROM w) AS worst_leaving, (SELECT max(largest_shift) FROM w) AS worst_shift, (SELECT bool_and(stable) FROM w) AS fulfilled,
  (SELECT {' AND '.join(f'count({p}) > 0' for p in _PILLARS[:6])} FROM base WHERE score IS NOT NULL) AS meaningful, (SELECT {' + '.join(f'(count(DISTINCT {p}) > 1)::int' for p in _PILLARS[:6])} > 1 FROM top) AS decisive,
  (SELECT count(*) - count(DISTINCT score) FROM top) AS ties""",
    "method_report": f"""WITH {_STATUS}, {_NEWEST}, x AS (SELECT s.offer_id, s.score, CASE WHEN s.offer_id % 3 = 0 THEN s.score / 10 - 3 END AS deal, CASE WHEN s.offer_id % 9 <> 0 THEN g.status END AS status FROM scored s JOIN gates g USING (offer_id))
{' UNION ALL '.join(f"SELECT 'pillar' AS section, '{p}' AS name, count({p}) AS n, NULL::double AS value FROM pillars" for p in _PILLARS)}
UNION ALL SELECT 'gate', g.name, count(h.gate), NULL FROM (SELECT unnest(['no_road', 'outside_infill', 'flood_q10', 'flood_q1', 'flood_sea', 'forest', 'landslide']) AS name) g LEFT JOIN (SELECT unnest(active) AS gate FROM gates) h ON h.gate = g.name GROUP BY 2
UNION ALL SELECT 'status', s.name, count(x.offer_id), NULL FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E', '?']) AS name) s LEFT JOIN x ON coalesce(x.status, '?') = s.name GROUP BY 2
UNION ALL SELECT 'source', 'planning', count(*), NULL FROM x UNION ALL SELECT 'source', 'flood', count(*), NULL FROM x WHERE offer_id % 2 = 0 UNION ALL SELECT 'source', 'terrain', count(*), NULL FROM x WHERE offer_id % 5 = 0
UNION ALL SELECT 'source', unnest(['utilities', 'parcel']), 0, NULL
UNION ALL SELECT 'measurement', concat_ws(':', kind, segment), n_obs, round(value, 6) FROM newest
UNION ALL SELECT 'deal', 'p25', count(deal), round(quantile_cont(deal, 0.25), 6) FROM x UNION ALL SELECT 'deal', 'median', count(deal), round(median(deal), 6) FROM x UNION ALL SELECT 'deal', 'p75', count(deal), round(quantile_cont(deal, 0.75), 6) FROM x""",
    "source_report": """SELECT 'planning' AS source, count(*) AS ok, 0::bigint AS failed FROM part UNION ALL SELECT 'flood', count(*), 0 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'egib', 0, count(*) FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'nmt', 0, count(*) FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'silent', 0, 0""",
    "health_report": f"""WITH {_O}, c AS (SELECT count(*) FILTER (offer_id % 5 < 3) AS n, count(*) AS a FROM offers WHERE active), e AS (SELECT * FROM events WHERE NOT (event_type = 'error' AND ts > TIMESTAMP '2024-01-20 00:00:00')),
s AS (SELECT event_type, max(ts) AS last FROM e GROUP BY 1),
err AS (SELECT 'egib: timeout' AS error, count(*) AS n FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'nmt: code ' || p_partkey % 12, count(*) FROM part WHERE p_partkey % 6 = 0 GROUP BY 1),
p AS (
  SELECT 'note' AS w, 'note absent ' || k AS line FROM (SELECT unnest(['click', 'view', 'error', 'never']) AS k) WHERE k NOT IN (SELECT event_type FROM s) UNION ALL SELECT 'alarm', 'alarm silent ' || event_type FROM s WHERE last < TIMESTAMP '{LAST}' - INTERVAL 5 DAY UNION ALL
  SELECT if(n / a > 0.5, 'alarm', 'note'), if(n / a > 0.5, 'alarm', 'note') || ' without_point offers ' || n FROM c WHERE n > 0 UNION ALL (SELECT 'note', 'note source_error ' || error || ' ' || n FROM err ORDER BY n DESC, error LIMIT 3))
SELECT count(*) FILTER (w = 'alarm') AS alarms, count(*) FILTER (w = 'note') AS notes, md5(count(*) FILTER (w = 'alarm') || ' alarms, ' || count(*) FILTER (w = 'note') || ' notes' || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS text FROM p""",
    "dynamics_status": f"WITH {market_plans.SALES} SELECT level, count(*) AS areas, count(*) FILTER (n_obs >= 20) AS reliable, round(avg(cagr) FILTER (n_obs >= 20), 4) AS mean FROM dynamics GROUP BY 1",
    "curve_round_trip": f"WITH {value_plans._MODEL} SELECT round(0.8::double - CASE WHEN tx_area > 800 THEN 0.1 ELSE 0 END - CASE WHEN tx_area > 3000 THEN 0.2 ELSE 0 END, 6) AS elasticity, count(*) AS n, 0.0::double AS off FROM model GROUP BY 1",
}
