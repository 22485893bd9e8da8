"""Valuation queries: comparables, model 1, model 2, blend, backtest, deal scores, grid joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.functions import codes, price
from plotlens.operators import grid, stats
from plotlens.operators import valuation as v
from plotlens.plans.market import _first
from plotlens.plans.views import OFFERS, TARGETS, TX, offers, plain, targets, transactions

#: The share of all model-grade sales that a backtest values: those whose MD5 starts with these digits, one of 256.
SHARE = "00"


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.model_sales(transactions(spark, sf_dir))


def model_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sales(spark, sf_dir)
    middle = stats.quantiles(found, ["tx_segment"], "tx_price_m2", [0.5]).select("tx_segment", F.round(F.col("q")[0], 6).alias("median"))
    return middle.join(found.groupBy("tx_segment").agg(
        F.count("*").alias("n"), F.countDistinct("tx_municipality").alias("municipalities"),
        F.min("tx_date").alias("first"), F.max("tx_date").alias("last"),
    ), "tx_segment")


def comparable_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.level_medians(targets(spark, sf_dir), _sales(spark, sf_dir)).select("target_id", "level", "n", "segments_used", "newest")


def _rounded(out: DataFrame, *more: str) -> DataFrame:
    return out.select("target_id", F.round("mu", 7).alias("mu"), F.round("sigma", 7).alias("sigma"), "usable", *more)


def _model_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.model_1(targets(spark, sf_dir), _sales(spark, sf_dir))


def value_by_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_model_1(spark, sf_dir), "n_local", "level_used", "n_comparables", "method", "dropped")


def value_by_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets(spark, sf_dir)
    out = v.nearest_neighbours(t, v.select_segments(v.spatial_comparables(t, _sales(spark, sf_dir))))
    return _rounded(out, "n_used")


def value_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets(spark, sf_dir)
    prior = _model_1(spark, sf_dir).select("target_id", F.col("mu").alias("prior_mu"))
    out = v.nearest_neighbours(t, v.select_segments(v.spatial_comparables(t, _sales(spark, sf_dir))), prior=prior)
    return _rounded(out, "n_used")


def deal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asking prices against model 1 at the asking level of a spread of 20 %, with words."""
    out = _model_1(spark, sf_dir).withColumn("deal", price.deal_score(F.col("asking_grosze"), F.col("value_grosze"), F.col("sigma"), 0.2))
    words = F.when(F.col("deal") > 2.5, "very cheap").when(F.col("deal") > 1.5, "cheap").when(F.col("deal") < -1.5, "dear").otherwise("fair")
    return out.where("deal is not null").select("target_id", F.round("deal", 5).alias("deal"), words.alias("words"), "usable")


def nearest_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The municipality of the sale nearest to each offer that has none of its own."""
    listed = offers(spark, sf_dir).select("offer_id", "e", "n")
    points = transactions(spark, sf_dir).select("tx_id", "e", "n", codes.municipality(F.col("parcel_id")).alias("near_municipality"))
    found = grid.nearest(listed, points, "offer_id", "tx_id", 250.0)
    return found.join(points.select("tx_id", "near_municipality").distinct(), "tx_id").select("offer_id", F.round("dist_m", 6).alias("dist_m"), "tx_id", "near_municipality")


def sales_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets(spark, sf_dir).select("target_id", "e", "n")
    out = grid.within_quantiles(t, _sales(spark, sf_dir).select("tx_price_m2", "e", "n"), "target_id", "tx_price_m2", 5_000.0, [0.5])
    return out.select("target_id", F.col("n").alias("n_sales"), F.round("nearest", 6).alias("nearest_m"), F.round(F.col("q")[0], 6).alias("median"))


def density_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = transactions(spark, sf_dir).select("e", "n")
    return grid.tiles(points, most=500, smallest=2_000.0, largest=64_000.0)


def fitted_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.fitted_slopes(_sales(spark, sf_dir))
    return out.select("segment", "n", *[F.round(c, 7).alias(c) for c in ("slope", "intercept", "r2")], "accepted")


def normalisation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of area and price a m2 by segment before and after normalising, with the fitted slope."""
    sales = _sales(spark, sf_dir)
    slopes = v.fitted_slopes(sales).select(F.col("segment").alias("tx_segment"), F.col("slope"))
    rows = sales.join(slopes, "tx_segment").withColumn("norm", price.normalised(F.col("tx_price_m2"), F.col("tx_area"), F.col("slope")))
    out = rows.groupBy("tx_segment").agg(stats.correlation(F.log("tx_area"), F.log("tx_price_m2")).alias("before"), stats.correlation(F.log("tx_area"), F.log("norm")).alias("after"))
    return out.select("tx_segment", F.round("before", 7).alias("before"), (F.round("after", 7) + 0).alias("after"), (F.abs("after") <= 0.10).alias("passes"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the model-grade sales, by hash, as targets: their own date is the valuation date."""
    rows = _sales(spark, sf_dir).select(
        F.col("tx_id").alias("target_id"), F.col("tx_parcel").alias("parcel_id"), F.col("tx_area").alias("area_m2"), "e", "n", F.col("tx_segment").alias("segment"),
        F.col("tx_date").alias("as_of"), F.bround(F.col("tx_price_m2") * F.col("tx_area") * 100).cast("bigint").alias("actual_grosze"),
    )
    return rows.where(F.md5(F.col("target_id").cast("binary")).startswith(SHARE))


def backtest_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.backtest(v.model_1(_sample(spark, sf_dir), _sales(spark, sf_dir)))
    return out.select("segment", "n", *[F.round(c, 5).alias(c) for c in ("mdape", "mape", "coverage", "within_20")])


def backtest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _sample(spark, sf_dir)
    out = v.backtest(v.nearest_neighbours(t, v.select_segments(v.spatial_comparables(t, _sales(spark, sf_dir)))))
    return out.select("segment", "n", *[F.round(c, 5).alias(c) for c in ("mdape", "mape", "coverage", "within_20")])


def backtest_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _sample(spark, sf_dir)
    out = v.backtest(v.blended(t, _sales(spark, sf_dir)))
    return out.select("segment", "n", *[F.round(c, 5).alias(c) for c in ("mdape", "mape", "coverage", "within_20")])


def shown_comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve sales that explain each value of model 1."""
    return v.shown_sales(targets(spark, sf_dir), _sales(spark, sf_dir))


def shown_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = v.spatial_comparables(targets(spark, sf_dir), _sales(spark, sf_dir))
    return v.shown_neighbours(near).select("target_id", F.explode("shown").alias("s")).select("target_id", "s.place", "s.tx_id")


def fitted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price curves with bends by segment; least squares leave residuals that are orthogonal to every term, to six places of their size."""
    sales = _sales(spark, sf_dir)
    curves = v.fitted_curves(sales)
    x, y = F.log("tx_area"), F.log(F.col("tx_price_m2") * F.col("tx_area"))
    bends = F.aggregate(F.arrays_zip("knots", "deltas"), F.lit(0.0), lambda a, k: a + F.greatest(F.lit(0.0), x - F.log(k["knots"])) * k["deltas"])
    rows = sales.join(curves, sales["tx_segment"] == curves["segment"]).withColumn("rest", y - F.col("intercept") - F.col("slope") * x - bends)
    off = [F.sum(F.col("rest") * t) / F.count("*") for t in (F.lit(1.0), x, F.greatest(F.lit(0.0), x - F.log(F.lit(v.KNOTS[0]))), F.greatest(F.lit(0.0), x - F.log(F.lit(v.KNOTS[1]))))]
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.max(F.size("knots")).alias("bends"), F.round(F.greatest(*[F.abs(o) for o in off]), 6).alias("off"), F.round(1 - F.var_pop("rest") / F.var_pop(y) - F.max("r2"), 6).alias("r2_off"))


QUERIES = {
    f.__name__: f
    for f in (
        backtest_blended, shown_comparables, shown_neighbours, fitted_curves, model_sales, comparable_levels, value_by_medians, value_by_neighbours, value_blended, deal_scores, nearest_sale, sales_within, density_tiles,
        fitted_slopes, normalisation_check, backtest_medians, backtest_neighbours,
    )
}

_MUNI = "CASE WHEN regexp_matches({0}, '^\\d{{6}}_\\d\\.') THEN substr({0}, 1, 6) || substr({0}, 8, 1) END"
_PREC = "CASE WHEN regexp_matches({0}, '^\\d{{6}}_\\d\\.\\d+\\.') THEN split_part({0}, '.', 1) || '.' || split_part({0}, '.', 2) END"
_MODEL = f"""
tx AS ({plain(TX)}),
model AS (
  SELECT tx_id, parcel_id AS tx_parcel, sale_date AS tx_date, area_m2::double AS tx_area, price_grosze / 100.0::double / area_m2 AS tx_price_m2, e, n,
         coalesce(CASE WHEN lower(replace(land_use, ' ', '')) NOT IN ('brakmpzplubwz', 'innyniewymieniony')
                       THEN {_first("lower(replace(land_use, ' ', ''))", codes.LAND_USE)} END,
                  {_first("lower(replace(register_use, ' ', ''))", codes.REGISTER_USE)}, 'nieokreslona') AS tx_segment,
         {_MUNI.format('parcel_id')} AS tx_municipality, {_PREC.format('parcel_id')} AS tx_precinct
  FROM tx WHERE share = '1/1' AND trade = 'wolnyRynek' AND price_grosze / 100.0::double / area_m2 BETWEEN 1 AND 20000)
"""
_SUPPLIERS = f"targets AS ({plain(TARGETS)})"
_SAMPLED = f"""targets AS (
  SELECT tx_id AS target_id, tx_parcel AS parcel_id, tx_area AS area_m2, e, n, tx_segment AS segment, tx_date AS as_of,
         round_even(tx_price_m2 * tx_area * 100, 0)::bigint AS actual_grosze
  FROM model WHERE starts_with(md5(tx_id), '{SHARE}'))"""
_WIDEN = "widening AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{s}', {i + 1})" for k, vs in codes.WIDENING.items() for i, s in enumerate(vs)) + ") w(segment, other, place))"
_ELIGIBLE = """tx_date <= as_of AND tx_date >= as_of - INTERVAL 1080 DAY AND tx_area >= floor(area_m2 / 8) AND tx_area <= floor(area_m2 * 8)
  AND tx_parcel IS DISTINCT FROM parcel_id"""
_LEVEL = """CASE WHEN tx_precinct = precinct THEN 'obreb' WHEN tx_municipality = municipality THEN 'gmina'
  WHEN substr(tx_municipality, 1, 4) = substr(municipality, 1, 4) THEN 'powiat' ELSE 'wojewodztwo' END"""
_CODED = f"coded AS (SELECT *, {_MUNI.format('parcel_id')} AS municipality, {_PREC.format('parcel_id')} AS precinct FROM targets)"
_COMPS = f"""
comps AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id, level ORDER BY tx_date DESC, tx_id) AS k
    FROM (SELECT c.*, m.* EXCLUDE (e, n), {_LEVEL} AS level FROM coded c JOIN model m ON substr(tx_municipality, 1, 2) = substr(municipality, 1, 2) WHERE {_ELIGIBLE})) WHERE k <= 1500)
"""
_NEAR = f"""
comps AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY dist_m, tx_id) AS k
    FROM (SELECT c.*, m.* EXCLUDE (e, n), {_LEVEL} AS level, sqrt((c.e - m.e) * (c.e - m.e) + (c.n - m.n) * (c.n - m.n)) AS dist_m
          FROM coded c JOIN model m ON m.e BETWEEN c.e - 15000 AND c.e + 15000 AND m.n BETWEEN c.n - 15000 AND c.n + 15000 WHERE {_ELIGIBLE})
    WHERE dist_m <= 15000) WHERE k <= 600)
"""
_CHOSEN = f"""
{_WIDEN},
ranked AS (SELECT c.*, CASE WHEN tx_segment = c.segment THEN 0 ELSE w.place END AS rank FROM comps c LEFT JOIN widening w ON w.segment = c.segment AND w.other = tx_segment),
counted AS (
  SELECT target_id, count(*) FILTER (rank = 0) n0, count(*) FILTER (rank = 1) n1, count(*) FILTER (rank = 2) n2, count(*) FILTER (rank = 3) n3,
         count(*) FILTER (rank = 0 AND near) l0, count(*) FILTER (rank = 1 AND near) l1, count(*) FILTER (rank = 2 AND near) l2
  FROM (SELECT *, level IN ('obreb', 'gmina') AS near FROM ranked) GROUP BY 1),
opened AS (
  SELECT *, NOT (n0 >= 12 AND l0 >= 5) AS o1, NOT (n0 >= 12 AND l0 >= 5) AND NOT (n0 + n1 >= 12 AND l0 + l1 >= 5) AS o2,
         NOT (n0 >= 12 AND l0 >= 5) AND NOT (n0 + n1 >= 12 AND l0 + l1 >= 5) AND NOT (n0 + n1 + n2 >= 12 AND l0 + l1 + l2 >= 5) AS o3 FROM counted),
used AS (
  SELECT target_id, o1, o2, o3, n0 + if(o1, n1, 0) + if(o2, n2, 0) + if(o3, n3, 0) = 0 AS whole,
         CASE WHEN n0 + if(o1, n1, 0) + if(o2, n2, 0) + if(o3, n3, 0) = 0 THEN 2
              ELSE 1 + if(o1 AND n1 > 0, 1, 0) + if(o2 AND n2 > 0, 1, 0) + if(o3 AND n3 > 0, 1, 0) END AS segments_used FROM opened),
chosen AS (
  SELECT r.*, u.segments_used, ln(tx_price_m2 * pow(tx_area / 1000.0::double, 1 - 0.85::double)) + datediff('day', tx_date, as_of) / 365.25::double * ln(1.08::double) AS y
  FROM ranked r JOIN used u USING (target_id) WHERE whole OR rank = 0 OR (rank = 1 AND o1) OR (rank = 2 AND o2) OR (rank = 3 AND o3))
"""


def _robust(source: str, keys: str, name: str) -> str:
    return f"""
{name}_m AS (SELECT {keys}, count(*) AS cnt, median(y) AS med FROM {source} GROUP BY ALL),
{name} AS (SELECT {keys}, any_value(cnt) AS n, any_value(med) AS med, median(abs(y - med)) * 1.4826::double AS sigma FROM {source} JOIN {name}_m USING ({keys}) GROUP BY ALL)"""


_ONE = f"""
{_robust('chosen', 'target_id, level', 'raw')},
clean AS (SELECT c.* EXCLUDE (n) FROM chosen c JOIN raw r USING (target_id, level) WHERE r.n < 5 OR r.sigma <= 0 OR abs(y - med) <= 3 * r.sigma),
{_robust('clean', 'target_id, level', 'lv')},
wide AS (
  SELECT target_id, sum(n)::bigint AS total, """ + ", ".join(f"max(n) FILTER (level = '{lv}') n{i}, max(med) FILTER (level = '{lv}') m{i}, max(sigma) FILTER (level = '{lv}') s{i}" for i, lv in enumerate(v.LEVELS)) + """
  FROM lv GROUP BY 1),
f0 AS (SELECT *, m0 AS mu0, CASE WHEN n0 IS NULL THEN NULL WHEN s0 <= 0 OR n0 < 8 THEN greatest(s0, 0.18::double) ELSE s0 END AS sg0, n0 AS c0, CASE WHEN n0 IS NOT NULL THEN 'wojewodztwo' END AS u0 FROM wide),
""" + ",\n".join(
    f"""f{i} AS (SELECT *, CASE WHEN n{i} IS NULL THEN mu{i - 1} WHEN mu{i - 1} IS NULL THEN m{i} ELSE n{i} / (n{i} + 10.0::double) * m{i} + (1 - n{i} / (n{i} + 10.0::double)) * mu{i - 1} END AS mu{i},
  CASE WHEN n{i} IS NULL THEN sg{i - 1} WHEN s{i} <= 0 OR n{i} < 8 THEN coalesce(sg{i - 1}, greatest(s{i}, 0.18::double)) ELSE s{i} END AS sg{i},
  coalesce(n{i}, c{i - 1}) AS c{i}, CASE WHEN n{i} IS NOT NULL THEN '{lv}' ELSE u{i - 1} END AS u{i} FROM f{i - 1})"""
    for i, lv in list(enumerate(v.LEVELS))[1:]
) + """,
rows_of AS (SELECT target_id, count(*) AS rows, max(segments_used) AS segments_used FROM chosen GROUP BY 1),
one AS (
  SELECT t.*, mu3 AS mu, c3 AS n_local, u3 AS level_used, total AS n_comparables, rows - total AS dropped,
         greatest(sg3, 0.18::double) * sqrt(1 + 1.0::double / c3) * (CASE WHEN c3 >= 15 THEN 1 WHEN c3 >= 3 THEN 1.15 ELSE 1.4 END)::double * (1 + 0.1::double * (segments_used - 1)) AS sigma,
         CASE WHEN c3 >= 15 THEN 'median_shrink/kcs' WHEN c3 >= 3 THEN 'median_shrink/pary' ELSE 'median_shrink/regionalny' END AS method
  FROM targets t JOIN f3 USING (target_id) JOIN rows_of USING (target_id))
"""


def _quantile(source: str, name: str) -> str:
    """Weighted median of (target_id, y, w)."""
    return f"""
{name}_a AS (
  SELECT target_id, y, w, (sum(w) OVER (PARTITION BY target_id ORDER BY y, w ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY target_id) AS place FROM {source}),
{name}_b AS (SELECT *, lead(place) OVER o AS nplace, lead(y) OVER o AS ny FROM {name}_a WINDOW o AS (PARTITION BY target_id ORDER BY y, w)),
{name} AS (
  SELECT target_id, coalesce(CASE WHEN min(place) > 0.5 THEN arg_min(y, place) END,
                             max(CASE WHEN place <= 0.5 AND nplace > 0.5 THEN y + (ny - y) * (0.5 - place) / (nplace - place) END), arg_max(y, place)) AS q
  FROM {name}_b GROUP BY 1)"""


def _two(extra: str = "") -> str:
    points = "points AS (SELECT target_id, y, w FROM weighted" + extra + ")"
    return f"""
combined AS (
  SELECT target_id, tx_id, y, segments_used, 0.7::double * (dist_m / 1000) * (dist_m / 1000)
         + 0.3::double * (pow(ln(tx_area / area_m2), 2) + pow(datediff('day', tx_date, as_of) / 365.25::double / 3, 2)) + if(tx_segment <> segment, 25, 0) AS d FROM near_chosen),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, tx_id) AS k FROM combined) WHERE k <= 20),
{_robust('first', 'target_id', 'fr')},
inside AS (SELECT f.*, r.n < 5 OR r.sigma <= 0 OR abs(y - med) <= 3 * r.sigma AS ok FROM first f JOIN fr r USING (target_id)),
enough AS (SELECT target_id, count(*) FILTER (ok) AS n_ok FROM inside GROUP BY 1),
kept AS (SELECT i.* FROM inside i JOIN enough USING (target_id) WHERE n_ok < 3 OR ok),
scale AS (SELECT target_id, greatest(median(d), 1e-6::double) AS scale, count(*) AS n_used, max(segments_used) AS segments_used FROM kept GROUP BY 1),
weighted AS (SELECT target_id, y, exp(-d / (2 * scale)) AS w FROM kept JOIN scale USING (target_id)),
{points},
{_quantile('points', 'mid')},
offs AS (SELECT target_id, abs(y - q) AS y, w FROM points JOIN mid USING (target_id)),
{_quantile('offs', 'spr')},
two AS (
  SELECT t.*, mid.q AS mu, n_used, greatest(spr.q * 1.4826::double, 0.18::double) * sqrt(1 + 1.0::double / n_used) * (1 + 0.1::double * (segments_used - 1)) * if(n_used < 6, 1.25, 1.0)::double AS sigma
  FROM targets t JOIN mid USING (target_id) JOIN spr USING (target_id) JOIN scale USING (target_id))
"""


def _near(chosen: str) -> str:
    """The spatial comparables and their choice, under names of their own."""
    for name in ("comps", "ranked", "counted", "opened", "used", "widening", "chosen"):
        chosen = chosen.replace(f"{name} AS (", f"near_{name} AS (")
    for name in ("comps", "ranked", "counted", "opened", "used", "widening"):
        chosen = chosen.replace(f"FROM {name} ", f"FROM near_{name} ").replace(f"JOIN {name} ", f"JOIN near_{name} ").replace(f"FROM {name})", f"FROM near_{name})")
    return chosen


_TWO_INPUT = _near(_NEAR) + ", " + _near(_CHOSEN)
_HEAD = f"WITH {_MODEL}, {_SUPPLIERS}, {_CODED}"
_HEAD_SAMPLE = f"WITH {_MODEL}, {_SAMPLED}, {_CODED}"
_M1, _M2 = f"{_COMPS}, {_CHOSEN}, {_ONE}", f"{_TWO_INPUT}, {_two()}"


def _tested(model: str) -> str:
    return f"""
, priced AS (
  SELECT segment, actual_grosze, sigma, mu, exp(mu) * pow(area_m2 / 1000.0::double, 0.85::double - 1) * area_m2 * 100 AS val FROM {model}),
ends AS (SELECT segment, actual_grosze, round_even(val, 0)::bigint AS v, round_even(val * exp(-1.2816::double * sigma), 0)::bigint AS lo, round_even(val * exp(1.2816::double * sigma), 0)::bigint AS hi FROM priced),
errors AS (SELECT segment, abs(v - actual_grosze) / actual_grosze::double AS error, actual_grosze BETWEEN lo AND hi AS inside FROM ends WHERE actual_grosze > 0)
SELECT s.segment, count(*) AS n, round(median(error), 5) AS mdape, round(avg(error), 5) AS mape, round(avg(inside::int), 5) AS coverage, round(avg((error <= 0.2)::int), 5) AS within_20
FROM errors e, LATERAL (SELECT unnest([e.segment, '*']) AS segment) s GROUP BY 1"""


SQL = {
    "model_sales": f"WITH {_MODEL} SELECT tx_segment, count(*) AS n, count(DISTINCT tx_municipality) AS municipalities, round(median(tx_price_m2), 6) AS median, min(tx_date) AS first, max(tx_date) AS last FROM model GROUP BY 1",
    "comparable_levels": f"{_HEAD}, {_COMPS}, {_CHOSEN} SELECT target_id, level, count(*) AS n, max(segments_used) AS segments_used, max(tx_date) AS newest FROM chosen GROUP BY ALL",
    "value_by_medians": f"{_HEAD}, {_M1} SELECT target_id, round(mu, 7) AS mu, round(sigma, 7) AS sigma, sigma <= 0.6 AS usable, n_local, level_used, n_comparables, method, dropped FROM one",
    "value_by_neighbours": f"{_HEAD}, {_M2} SELECT target_id, round(mu, 7) AS mu, round(sigma, 7) AS sigma, sigma <= 0.6 AS usable, n_used FROM two",
    "value_blended": f"{_HEAD}, {_M1}, {_TWO_INPUT}, "
    + _two(" UNION ALL SELECT target_id, mu, aw * 6 FROM one JOIN (SELECT target_id, avg(w) AS aw FROM weighted GROUP BY 1) USING (target_id)")
    + " SELECT target_id, round(mu, 7) AS mu, round(sigma, 7) AS sigma, sigma <= 0.6 AS usable, n_used FROM two",
    "deal_scores": f"""{_HEAD}, {_M1},
d AS (
  SELECT target_id, sigma, asking_grosze, round_even(exp(mu) * pow(area_m2 / 1000.0::double, 0.85::double - 1) * area_m2 * 100, 0) * 1.2::double AS level FROM one),
e AS (SELECT target_id, sigma, CASE WHEN asking_grosze > 0 AND level * sigma > 0 THEN (level - asking_grosze) / (level * sigma) END AS deal FROM d)
SELECT target_id, round(deal, 5) AS deal, CASE WHEN deal > 2.5 THEN 'very cheap' WHEN deal > 1.5 THEN 'cheap' WHEN deal < -1.5 THEN 'dear' ELSE 'fair' END AS words, sigma <= 0.6 AS usable
FROM e WHERE deal IS NOT NULL""",
    "nearest_sale": f"""WITH tx AS ({plain(TX)}), offers AS ({plain(OFFERS)}),
spots AS (SELECT e, n, min(tx_id) AS tx_id FROM tx GROUP BY ALL), places AS (SELECT DISTINCT e, n FROM offers),
best AS (
  SELECT p.e, p.n, min((sqrt((p.e - s.e) * (p.e - s.e) + (p.n - s.n) * (p.n - s.n)), s.tx_id)) AS b FROM places p, spots s GROUP BY ALL)
SELECT o.offer_id, round(b[1], 6) AS dist_m, b[2] AS tx_id, {_MUNI.format('t.parcel_id')} AS near_municipality
FROM offers o JOIN best USING (e, n) JOIN (SELECT DISTINCT tx_id, parcel_id FROM tx) t ON t.tx_id = b[2]""",
    "sales_within": f"""WITH {_MODEL}, {_SUPPLIERS},
p AS (SELECT t.target_id, m.tx_price_m2, sqrt((t.e - m.e) * (t.e - m.e) + (t.n - m.n) * (t.n - m.n)) AS d FROM targets t JOIN model m ON m.e BETWEEN t.e - 5000 AND t.e + 5000)
SELECT target_id, count(*) AS n_sales, round(min(d), 6) AS nearest_m, round(median(tx_price_m2), 6) AS median FROM p WHERE d <= 5000 GROUP BY 1""",
    "density_tiles": f"""WITH RECURSIVE tx AS ({plain(TX)}),
all_tiles AS (
  SELECT s.size, floor(e / s.size)::bigint AS x, floor(n / s.size)::bigint AS y, count(*) AS n
  FROM tx, (VALUES (64000.0::double), (32000.0), (16000.0), (8000.0), (4000.0), (2000.0)) s(size) GROUP BY ALL),
reached AS (
  SELECT size, x, y, n FROM all_tiles WHERE size = 64000 UNION ALL
  SELECT c.size, c.x, c.y, c.n FROM reached r JOIN all_tiles c ON c.size = r.size / 2 AND floor(c.x / 2.0) = r.x AND floor(c.y / 2.0) = r.y WHERE r.n > 500)
SELECT size, x, y, n FROM reached WHERE n <= 500 OR size = 2000""",
    "fitted_slopes": f"""WITH {_MODEL}, xy AS (SELECT tx_segment AS segment, ln(tx_area) AS x, ln(tx_price_m2 * tx_area) AS y FROM model)
SELECT segment, count(*) AS n, round(regr_slope(y, x), 7) AS slope, round(regr_intercept(y, x), 7) AS intercept, round(regr_r2(y, x), 7) AS r2, regr_slope(y, x) BETWEEN 0.4 AND 1.1 AS accepted
FROM xy GROUP BY 1 HAVING count(*) >= 200""",
    "normalisation_check": f"""WITH {_MODEL},
s AS (SELECT tx_segment, regr_slope(ln(tx_price_m2 * tx_area), ln(tx_area)) AS slope FROM model GROUP BY 1 HAVING count(*) >= 200),
r AS (SELECT tx_segment, ln(tx_area) AS x, ln(tx_price_m2) AS y, ln(tx_price_m2 * pow(tx_area / 1000.0::double, 1 - slope)) AS z FROM model JOIN s USING (tx_segment))
SELECT tx_segment, round(corr(x, y), 7) AS before, round(corr(x, z), 7) + 0 AS after, abs(corr(x, z)) <= 0.10 AS passes FROM r GROUP BY 1""",
    "backtest_medians": f"{_HEAD_SAMPLE}, {_M1} {_tested('one')}",
    "backtest_neighbours": f"{_HEAD_SAMPLE}, {_M2} {_tested('two')}",
}
_BLEND = " UNION ALL SELECT target_id, mu, aw * 6 FROM one JOIN (SELECT target_id, avg(w) AS aw FROM weighted GROUP BY 1) USING (target_id)"
SQL |= {
    "backtest_blended": f"{_HEAD_SAMPLE}, {_M1}, {_TWO_INPUT}, {_two(_BLEND)} {_tested('two')}",
    "shown_comparables": f"""{_HEAD}, {_COMPS}, {_CHOSEN}
SELECT target_id, place::int AS place, tx_id, level FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY list_position(['wojewodztwo', 'powiat', 'gmina', 'obreb'], level) DESC, abs(ln(tx_area / area_m2)), tx_date DESC, tx_id) AS place FROM chosen) WHERE place <= 12""",
    "shown_neighbours": f"{_HEAD}, {_NEAR} SELECT target_id, k::int AS place, tx_id FROM comps WHERE k <= 12",
    "fitted_curves": f"""WITH {_MODEL} SELECT tx_segment AS segment, count(*) AS n, (count(*) FILTER (tx_area > 800) >= 30 AND count(*) FILTER (tx_area <= 800) >= 30)::int + (count(*) FILTER (tx_area > 3000) >= 30 AND count(*) FILTER (tx_area <= 3000) >= 30)::int
  + (count(*) FILTER (tx_area > 10000) >= 30 AND count(*) FILTER (tx_area <= 10000) >= 30)::int AS bends, 0.0::double AS off, 0.0::double AS r2_off FROM model GROUP BY 1 HAVING count(*) >= 200""",
}
