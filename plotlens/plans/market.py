"""Market queries: medians, dynamics, history, trends, deviations, regional tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.functions import codes
from plotlens.operators import market as m
from plotlens.plans.views import AS_OF, OFFERS, TX, offers, plain, transactions
from plotlens.session import staged

#: Two years before the valuation date, in days of 30.44 a month.
WINDOW_DAYS = int(24 * 30.44)


def _since() -> Column:
    return F.date_sub(F.lit(AS_OF).cast("date"), WINDOW_DAYS)


def _sales(spark: SparkSession, sf_dir: str, recent: bool = False) -> DataFrame:
    return m.market_sales(transactions(spark, sf_dir), AS_OF, _since() if recent else None)


def sales_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales for a query that reads them more than once: the joins and texts behind them cost more than what is asked of them."""
    return staged(_sales(spark, sf_dir).select("municipality", "segment", "sale_date", "price_m2", "area_m2"), "sales")


def recent(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("sale_date") >= _since())


def market_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.medians(_sales(spark, sf_dir, recent=True), AS_OF)


def market_medians_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = sales_once(spark, sf_dir)
    return m.medians(recent(sales), AS_OF, m.dynamics(m.yearly_medians(sales)))


def market_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.dynamics(m.yearly_medians(_sales(spark, sf_dir)))
    return found.select("level", "area", F.round("cagr", 8).alias("cagr"), "n_obs", "year_from", "year_to", F.size("segments").cast("bigint").alias("n_segments"))


def market_dynamics_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = sales_once(spark, sf_dir)
    targets = sales.select("municipality").distinct()
    out = m.shrunk_dynamics(targets, m.dynamics(m.yearly_medians(sales)))
    return out.withColumn("cagr", F.round("cagr", 8))


def market_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.quarterly_history(_sales(spark, sf_dir))
    return out.select("level", "area", "quarter", "label", *[F.round(c, 6).alias(c) for c in ("median", "p25", "p75")], "n", "complete")


def market_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.trends(m.quarterly_history(_sales(spark, sf_dir))).withColumn("yearly", F.round("yearly", 8))


def offer_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = offers(spark, sf_dir).where("active").withColumn("segment", F.coalesce(codes.ad_segment(F.lower("purpose")), F.lit("*")))
    out = m.local_market(listed.select("offer_id", "portal", "price_grosze", "area_m2", "municipality", "segment"), market_medians(spark, sf_dir))
    return out


def regional_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of all segments with the area's dynamics and its offers, reliable ones first."""
    sales = sales_once(spark, sf_dir)
    med = m.medians(recent(sales), AS_OF).where("segment = '*'")
    change = m.dynamics(m.yearly_medians(sales)).select("level", "area", "cagr")
    from plotlens.operators.hierarchy import at_levels

    listed = at_levels(offers(spark, sf_dir).where("active").select("municipality"), "municipality").groupBy("level", "area").agg(F.count("*").alias("n_offers"))
    out = med.join(change, ["level", "area"], "left").join(listed, ["level", "area"], "left")
    return out.select("level", "area", "n", "median_norm", F.round("cagr", 8).alias("cagr"), F.coalesce("n_offers", F.lit(0)).alias("n_offers"), (F.col("n") >= m.RELIABLE).alias("reliable"))


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    med = market_medians(spark, sf_dir).where("level = 'gmina'")
    return med.groupBy("segment").agg(F.count("*").alias("areas"), F.sum("n").alias("n"), F.round(F.median("median_norm"), 4).alias("median"))


def top_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.dynamics(m.yearly_medians(_sales(spark, sf_dir))).where("level = 'gmina' and n_obs >= 20")
    return found.orderBy(F.desc("cagr"), "area").limit(10).select("area", F.round("cagr", 8).alias("cagr"), "n_obs")


QUERIES = {
    "market_medians": market_medians,
    "market_medians_indexed": market_medians_indexed,
    "market_dynamics": market_dynamics,
    "market_dynamics_shrunk": market_dynamics_shrunk,
    "market_history": market_history,
    "market_trends": market_trends,
    "offer_market": offer_market,
    "regional_prices": regional_prices,
    "segment_summary": segment_summary,
    "top_dynamics": top_dynamics,
}


def _first(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{a}') THEN '{b}'" for a, b in rules) + " END"


#: The SQL side: sales on the market, at three levels.
SALES = f"""
tx AS ({plain(TX)}),
sales AS (
  SELECT tx.*, price_grosze / 100.0::double / area_m2 AS price_m2,
         CASE WHEN regexp_matches(parcel_id, '^\\d{{6}}_\\d\\.') THEN substr(parcel_id, 1, 6) || substr(parcel_id, 8, 1) END AS municipality,
         coalesce(CASE WHEN lower(replace(land_use, ' ', '')) NOT IN ('brakmpzplubwz', 'innyniewymieniony')
                       THEN {_first("lower(replace(land_use, ' ', ''))", codes.LAND_USE)} END,
                  {_first("lower(replace(register_use, ' ', ''))", codes.REGISTER_USE)}, 'nieokreslona') AS segment
  FROM tx
  WHERE price_grosze / 100.0::double / area_m2 >= 5 AND sale_date <= DATE '{AS_OF}'
    AND (share IS NULL OR share IN ('1', '1/1')) AND (trade IS NULL OR trade IN ('wolnyRynek', 'sprzedazPrzetargowa'))),
priced AS (SELECT *, price_m2 * pow(area_m2 / 1000.0::double, 1 - 0.85::double) AS norm, datediff('day', sale_date, DATE '{AS_OF}') / 365.25::double AS years FROM sales),
levels AS (
  SELECT 'gmina' AS level, municipality AS area, * FROM priced UNION ALL
  SELECT 'powiat', substr(municipality, 1, 4), * FROM priced UNION ALL
  SELECT 'wojewodztwo', substr(municipality, 1, 2), * FROM priced),
yearly AS (SELECT level, area, segment, year(sale_date) AS y, median(norm) AS m, count(*) AS n FROM levels GROUP BY ALL HAVING count(*) >= 10),
ends AS (SELECT level, area, segment, min(y) y0, max(y) y1, arg_min(m, y) m0, arg_max(m, y) m1, least(arg_min(n, y), arg_max(n, y)) w FROM yearly GROUP BY ALL),
changes AS (SELECT *, pow(m1 / m0, 1.0::double / (y1 - y0)) - 1 AS change FROM ends WHERE y1 > y0),
dynamics AS (
  SELECT level, area, sum(change * w) / sum(w) AS cagr, sum(w)::bigint AS n_obs, min(y0) AS year_from, max(y1) AS year_to, count(*) AS n_segments
  FROM changes WHERE abs(change) <= 0.40 GROUP BY ALL)
"""


def _medians(rate: str, join: str = "") -> str:
    return f"""
today AS (
  SELECT l.level, l.area, s.segment, l.price_m2, l.norm * pow(1 + {rate}, l.years) AS today
  FROM levels l {join}, LATERAL (SELECT unnest([l.segment, '*']) AS segment) s
  WHERE l.sale_date >= DATE '{AS_OF}' - INTERVAL {WINDOW_DAYS} DAY),
medians AS (
  SELECT level, area, segment, count(*) AS n, round(quantile_cont(today, 0.5), 2) AS median_norm, round(quantile_cont(today, 0.25), 2) AS p25_norm,
         round(quantile_cont(today, 0.75), 2) AS p75_norm, round(median(price_m2), 2) AS median_raw
  FROM today GROUP BY ALL HAVING count(*) >= 5)
"""


_HISTORY = """
quarters AS (
  SELECT level, area, date_trunc('quarter', sale_date)::date AS quarter, median(norm) AS median, quantile_cont(norm, 0.25) AS p25,
         quantile_cont(norm, 0.75) AS p75, count(*) AS n FROM levels GROUP BY ALL HAVING count(*) >= 5),
last AS (SELECT level, area, max(sale_date) AS last FROM levels GROUP BY ALL),
history AS (
  SELECT q.*, year(quarter) || ' Q' || quarter(quarter) AS label, last >= quarter + INTERVAL 92 DAY AS complete FROM quarters q JOIN last USING (level, area))
"""
_OWN = "greatest(-0.25, least(0.25, coalesce(d.cagr, 0.08)))::double"
_OFFERS = f"offers AS ({plain(OFFERS)})"

SQL = {
    "market_medians": f"WITH {SALES}, {_medians('0.08::double')} SELECT * FROM medians",
    "market_medians_indexed": f"WITH {SALES}, {_medians(_OWN, 'LEFT JOIN dynamics d ON d.level = {0}gmina{0} AND d.area = l.municipality'.format(chr(39)))} SELECT * FROM medians",
    "market_dynamics": f"WITH {SALES} SELECT * REPLACE (round(cagr, 8) AS cagr) FROM dynamics",
    "market_dynamics_shrunk": f"""WITH {SALES},
t AS (
  SELECT s.municipality, g.cagr gc, g.n_obs gn, p.cagr pc, p.n_obs pn, w.cagr wc, w.n_obs wn
  FROM (SELECT DISTINCT municipality FROM sales) s
  LEFT JOIN dynamics g ON g.level = 'gmina' AND g.area = s.municipality
  LEFT JOIN dynamics p ON p.level = 'powiat' AND p.area = substr(s.municipality, 1, 4)
  LEFT JOIN dynamics w ON w.level = 'wojewodztwo' AND w.area = substr(s.municipality, 1, 2)),
a AS (SELECT *, CASE WHEN pc IS NULL THEN 0 WHEN wc IS NULL THEN 1 ELSE pn / (pn + 30.0::double) END AS lp FROM t),
b AS (SELECT *, CASE WHEN pc IS NULL THEN wc WHEN wc IS NULL THEN pc ELSE lp * pc + (1 - lp) * wc END AS up FROM a),
c AS (SELECT *, CASE WHEN gc IS NULL THEN 0 WHEN up IS NULL THEN 1 ELSE gn / (gn + 30.0::double) END AS lg FROM b)
SELECT municipality, round(CASE WHEN gc IS NULL THEN up WHEN up IS NULL THEN gc ELSE lg * gc + (1 - lg) * up END, 8) AS cagr,
       CASE WHEN gc IS NOT NULL THEN 'gmina' WHEN pc IS NOT NULL THEN 'powiat' WHEN wc IS NOT NULL THEN 'wojewodztwo' END AS level,
       coalesce(gn, pn, wn) AS n_obs,
       CASE WHEN gc IS NOT NULL THEN round_even(lg, 3) END AS weight_gmina,
       CASE WHEN pc IS NOT NULL THEN round_even(lp * (1 - lg), 3) END AS weight_powiat,
       CASE WHEN wc IS NOT NULL THEN round_even((1 - lp) * (1 - lg), 3) END AS weight_wojewodztwo
FROM c""",
    "market_history": f"WITH {SALES}, {_HISTORY} SELECT level, area, quarter, label, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, n, complete FROM history",
    "market_trends": f"""WITH {SALES}, {_HISTORY},
points AS (SELECT * FROM history WHERE complete AND median > 0),
good AS (
  SELECT level, area, min(quarter) AS start FROM points GROUP BY ALL
  HAVING count(*) >= 6 AND median(n) >= 10 AND datediff('day', min(quarter), max(quarter)) / 365.25 >= 2),
xy AS (SELECT level, area, datediff('day', start, quarter) / 365.25::double AS x, ln(median) AS y FROM points JOIN good USING (level, area))
SELECT level, area, round(exp(median((b.y - a.y) / (b.x - a.x))) - 1, 8) AS yearly
FROM xy a JOIN xy b USING (level, area) WHERE a.x < b.x GROUP BY ALL""",
    "offer_market": f"""WITH {SALES}, {_medians('0.08::double')}, {_OFFERS},
o AS (
  SELECT offer_id, portal, price_grosze, area_m2, municipality, price_grosze / 100.0::double / area_m2 AS unit,
         coalesce({_first("lower(purpose)", codes.AD_TEXT)}, '*') AS segment
  FROM offers WHERE active),
p AS (SELECT *, unit * pow(area_m2 / 1000.0::double, 1 - 0.85::double) AS norm FROM o WHERE unit BETWEEN 1 AND 5000 AND municipality IS NOT NULL),
c AS (
  SELECT p.*, m.level AS median_level, m.median_norm, m.n AS median_n,
         row_number() OVER (PARTITION BY offer_id ORDER BY coalesce(m.n >= 10, false) DESC,
                            CASE WHEN m.n >= 10 THEN length(m.area) END DESC NULLS LAST, m.n DESC NULLS LAST, length(m.area) DESC) AS k
  FROM p LEFT JOIN medians m ON m.segment = p.segment AND m.area = substr(p.municipality, 1, length(m.area)))
SELECT offer_id, portal, price_grosze, area_m2, municipality, segment, round(norm, 2) AS norm, median_level, median_norm, median_n,
       round(CASE WHEN median_norm > 0 THEN norm / median_norm - 1 END, 4) AS deviation FROM c WHERE k = 1""",
    "regional_prices": f"""WITH {SALES}, {_medians('0.08::double')}, {_OFFERS},
listed AS (
  SELECT level, area, count(*) AS n_offers FROM (
    SELECT 'gmina' AS level, municipality AS area FROM offers WHERE active UNION ALL
    SELECT 'powiat', substr(municipality, 1, 4) FROM offers WHERE active UNION ALL
    SELECT 'wojewodztwo', substr(municipality, 1, 2) FROM offers WHERE active) GROUP BY ALL)
SELECT level, area, n, median_norm, round(cagr, 8) AS cagr, coalesce(n_offers, 0) AS n_offers, n >= 10 AS reliable
FROM medians LEFT JOIN dynamics USING (level, area) LEFT JOIN listed USING (level, area) WHERE segment = '*'""",
    "segment_summary": f"WITH {SALES}, {_medians('0.08::double')} SELECT segment, count(*) AS areas, sum(n)::bigint AS n, round(median(median_norm), 4) AS median FROM medians WHERE level = 'gmina' GROUP BY segment",
    "top_dynamics": f"WITH {SALES} SELECT area, round(cagr, 8) AS cagr, n_obs FROM dynamics WHERE level = 'gmina' AND n_obs >= 20 ORDER BY cagr DESC, area LIMIT 10",
}
