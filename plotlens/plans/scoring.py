"""Scoring and calibration queries over the plot view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.operators import calibration as c
from plotlens.operators import scoring as s
from plotlens.operators import stats
from plotlens.plans import valuation as value_plans
from plotlens.plans.views import PLOTS, plain, plots
from plotlens.session import dealt, staged


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(plots(spark, sf_dir), "offer_id").withColumn("floods", F.when(F.col("flood").isNotNull(), F.array("flood")))


def _scored(spark: SparkSession, sf_dir: str, profile: str = "retail") -> DataFrame:
    """The stored scores. What is asked of them is not pushed into the deep expressions that make them."""
    return staged(s.score_plots(_features(spark, sf_dir), profile), "scores")


def planning_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.planning_status(_features(spark, sf_dir))
    mid = F.round((F.col("value_low") + F.col("value_high")) / 2, 4)
    return out.select("offer_id", "status", F.round("value_low", 4).alias("value_low"), F.round("value_high", 4).alias("value_high"), "certain", mid.alias("midpoint"), F.round(F.col("value_high") - F.col("value_low"), 4).alias("width"))


def building_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.capacity(_features(spark, sf_dir))
    return out.select("offer_id", "floors", F.round("floor_area_m2", 4).alias("floor_area_m2"), F.round("usable_m2", 4).alias("usable_m2"), F.round("usable_per_m2", 6).alias("usable_per_m2"), "binding")


def pillar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.pillars(s.capacity(s.planning_status(_features(spark, sf_dir))))
    return out.select("offer_id", *[F.element_at("pillars", F.lit(k)).alias(k) for k in s.WEIGHTS["developer"]])


def gate_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.gates(s.planning_status(_features(spark, sf_dir)))
    names = F.array_join(F.transform("gates", lambda g: g["name"]), ",")
    return out.select("offer_id", names.alias("active"), F.round("multiplier", 6).alias("multiplier"), (F.col("multiplier") < 0.5).alias("disqualifying"))


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for profile in s.WEIGHTS:
        part = _scored(spark, sf_dir, profile).select(
            "offer_id", F.lit(profile).alias("profile"), "score", "coverage", F.array_join("lacking", ",").alias("lacking"), F.array_join("red_flags", ",").alias("red_flags")
        )
        out = part if out is None else out.union(part)
    return out


def pillar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select(F.explode("pillars").alias("pillar", "points"))
    return rows.groupBy("pillar").agg(F.count("*").alias("n"), F.count_if(F.col("points").isNotNull()).alias("known"))


def active_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate with how many plots it hits, those without a hit as zero."""
    hits = _scored(spark, sf_dir).select(F.explode("gates").alias("g")).groupBy(F.col("g.name").alias("gate")).agg(F.count("*").alias("n"))
    names = ["no_road", "outside_infill", *[g[1] for g in s.FLOOD_GATES], "forest", "landslide"]
    catalogue = spark.createDataFrame([(n,) for n in names], "gate string")
    return catalogue.join(hits, "gate", "left").select("gate", F.coalesce("n", F.lit(0)).alias("n"))


def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("score")
    scored = _scored(spark, sf_dir)
    middle = stats.quantiles(scored.withColumn("all", F.lit(1)), ["all"], "score", [0.5]).select(F.col("q")[0].alias("median"))
    counts = scored.agg(
        F.count("*").alias("plots"), F.count("score").alias("scored"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
        F.count_if(x < 30).alias("below_30"), F.count_if(x >= 70).alias("at_least_70"), F.count_if(F.col("coverage") < s.LEAST_COVERAGE).alias("thin"),
    )
    return counts.join(F.broadcast(middle))  # a row each


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotlens.operators.stats import histogram

    return histogram(_scored(spark, sf_dir), "score")


def score_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.discrimination(_scored(spark, sf_dir))
    return out.select("n", *[F.round(x, 7).alias(x) for x in ("fullest_share", "iqr", "median", "sd")], "distinguishes")


def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.sensitivity(_scored(spark, sf_dir), "offer_id")
    return out.select("run", "leaving", "lost", "largest_shift", F.round("median_shift", 4).alias("median_shift"), F.round("overlap", 6).alias("overlap"), F.round("rho", 6).alias("rho"), "stable")


def random_weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the first ten under twenty random weight sets."""
    runs = c.random_runs()
    top = staged(c.first_of(c.rescored(_scored(spark, sf_dir), runs, "offer_id"), [n for n, _ in runs], "offer_id", c.TOP), "random-tops")  # ``TOP`` rows a run
    base = top.where("run = 'base'").select("offer_id")
    return top.where("run <> 'base'").join(base, "offer_id", "left_semi").groupBy("run").agg((F.count("*") / c.TOP).alias("overlap"))


def rescoring_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from stored pillars and multipliers against the first ones: how many differ by over 0.15."""
    first = _scored(spark, sf_dir)
    again = s.composite(first.drop("coverage", "lacking"), rounded=False, name="again")
    off = F.abs(F.col("score") - F.col("again")) > 0.15
    return again.agg(F.count("*").alias("n"), F.count_if(F.coalesce(off, F.lit(False))).alias("differ"), F.count_if(F.col("score").isNull() != F.col("again").isNull()).alias("null_differs"))


def asking_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    valued = value_plans._model_1(spark, sf_dir).select("segment", F.col("asking_grosze").alias("price_grosze"), "value_grosze")
    out = c.spread(valued)
    return out.select("segment", "n", *[F.round(x, 6).alias(x) for x in ("spread", "p25", "p75", "mad")], "usable")


QUERIES = {
    f.__name__: f
    for f in (
        planning_status, building_capacity, pillar_scores, gate_multipliers, composite_scores, pillar_coverage, active_gates, score_statistics, score_histogram,
        score_discrimination, weight_sensitivity, random_weight_sensitivity, rescoring_check, asking_spread,
    )
}


def _scale(x: str, lo: float, hi: float, inverted: bool = False) -> str:
    part = f"greatest(0, least(1, (({x})::double - {lo}) / ({hi}::double - {lo})))"
    return f"CASE WHEN {x} IS NOT NULL THEN round_even(({'1 - ' if inverted else ''}{part}) * 100, 1) END"


def _mean(*parts: str) -> str:
    return f"round_even(list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), 1)"


_ROAD = "CASE road WHEN 0 THEN 0.0::double WHEN 1 THEN 60 WHEN 2 THEN 100 END"
_BUILD = "('SW', 'SJ', 'SZ', 'SU', 'SH', 'SP')"
_STATUS = f"""
plots AS ({plain(PLOTS)}),
symbols AS (SELECT *, CASE local_symbol WHEN '12MN/U' THEN 'MNU' WHEN 'ZL' THEN 'ZL' END AS sym FROM plots),
status AS (
  SELECT *, CASE WHEN sym = 'MNU' THEN 'A' WHEN local_plan AND sym IS NULL THEN '?' WHEN general_plan AND infill AND zone NOT IN {_BUILD} THEN 'D'
                 WHEN general_plan AND infill THEN 'B' WHEN permit THEN 'C' WHEN general_plan AND NOT infill THEN 'D' WHEN NOT general_plan THEN 'E' ELSE '?' END AS status,
         coalesce(sym = 'MNU', false) AS c1, coalesce(local_plan AND sym IS NULL, false) AS c2,
         coalesce(general_plan AND infill AND zone NOT IN {_BUILD}, false) AS c3, coalesce(general_plan AND NOT infill AND zone IN {_BUILD}, false) AS c6
  FROM symbols),
ranges AS (
  SELECT *, CASE WHEN NOT c1 AND c2 THEN 0.45 WHEN status = 'D' AND c6 AND NOT c3 THEN 0.4 ELSE (MAP {{'A': 1.0, 'B': 0.9, 'C': 0.85, 'D': 0.3, 'E': 0.5, '?': 0.5}})[status] END::double AS value_low,
         (MAP {{'A': 1.0, 'B': 1.0, 'C': 0.95, 'D': 0.5, 'E': 0.75, '?': 1.0}})[status]::double AS value_high, status <> '?' AND NOT (c3 AND NOT c1 AND NOT c2) AS certain FROM status),
limits AS (
  SELECT *, floor(height_m / 3.2)::int AS floors, area_m2 * intensity AS l0, area_m2 * footprint_pct / 100 * floor(height_m / 3.2) AS l1,
         area_m2 * (1 - green_pct / 100) * floor(height_m / 3.2) AS l2 FROM ranges),
capacity AS (
  SELECT *, least(l0, l1, l2) AS floor_area_m2, least(l0, l1, l2) * (CASE WHEN zone IN ('SJ', 'SZ') THEN 0.8 ELSE 0.7 END)::double AS usable_m2,
         CASE WHEN l0 <= least(l0, l1, l2) THEN 'intensity' WHEN l1 <= least(l0, l1, l2) THEN 'footprint' WHEN l2 <= least(l0, l1, l2) THEN 'green' END AS binding FROM limits),
pillars AS (
  SELECT *, (MAP {{'A': 100.0, 'B': 88.0, 'C': 80.0, 'D': 20.0, 'E': 55.0, '?': 50.0}})[status]::double AS planning,
         {_mean(_scale('travel_min', 10, 60, True), _scale('sea_m', 500, 20000, True))} AS location,
         {_mean(_scale('utility_cost', 0, 150000, True), _ROAD)} AS infrastructure,
         {_mean(_scale('frontage', 10, 30), _scale('slope', 0, 15, True), _scale('compactness', 0.35, 0.78))} AS physical,
         CASE WHEN flood_checked THEN least(CASE flood WHEN 'q10' THEN 10 WHEN 'q1' THEN 30 WHEN 'hWZ' THEN 45 WHEN 'q0_2' THEN 75 ELSE 100 END, CASE WHEN protected THEN 60 ELSE 100 END)::double END AS risk,
         {_mean(_scale('price_change', -0.05, 0.20))} AS market, {_scale('usable_m2 / area_m2', 0.2, 1.5)} AS capacity
  FROM capacity),
gates AS (
  SELECT *, list_filter([CASE WHEN road = 0 THEN 'no_road' END, CASE WHEN status = 'D' THEN 'outside_infill' END,
                         CASE flood WHEN 'q10' THEN 'flood_q10' WHEN 'q1' THEN 'flood_q1' WHEN 'hWZ' THEN 'flood_sea' END,
                         CASE WHEN contains(lower(register_use), 'lesn') AND NOT deforestable THEN 'forest' END], lambda x: x IS NOT NULL) AS active,
         (CASE WHEN road = 0 THEN 0.35 ELSE 1 END)::double * (CASE WHEN status = 'D' THEN 0.40 ELSE 1 END)::double * (CASE flood WHEN 'q10' THEN 0.40 WHEN 'q1' THEN 0.55 WHEN 'hWZ' THEN 0.60 ELSE 1 END)::double
         * (CASE WHEN contains(lower(register_use), 'lesn') AND NOT deforestable THEN 0.30 ELSE 1 END)::double AS multiplier FROM pillars)
"""


def _score(weights: dict[str, float], rounded: bool = True) -> tuple[str, str]:
    held = " + ".join(f"(CASE WHEN {k} IS NOT NULL THEN {w!r} ELSE 0 END)::double" for k, w in weights.items())
    total = " + ".join(f"coalesce({k} * {w!r}::double, 0)" for k, w in weights.items())
    share = f"({held}) / ({' + '.join(f'{w!r}::double' for w in weights.values())})"
    coverage = f"round_even({share}, 3)" if rounded else share
    return f"CASE WHEN {coverage} >= 0.40 THEN round_even(round(({total}) / ({held}) * multiplier, 9), 1) END", coverage


def _profile(name: str) -> str:
    score, coverage = _score(s.WEIGHTS[name])
    lacking = ", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in sorted(s.WEIGHTS[name]))
    return f"""SELECT offer_id, '{name}' AS profile, {score} AS score, {coverage} AS coverage,
  array_to_string(list_filter([{lacking}], lambda x: x IS NOT NULL), ',') AS lacking,
  array_to_string(list_filter([CASE WHEN frontage < 18 THEN 'narrow_front' END, CASE WHEN compactness < 0.45 THEN 'odd_shape' END, CASE WHEN utility_cost > 60000 THEN 'dear_utilities' END,
    CASE WHEN status = 'D' THEN 'no_building' END, CASE WHEN flood IS NOT NULL THEN 'flood' END], lambda x: x IS NOT NULL), ',') AS red_flags FROM gates"""


_RUNS = " UNION ALL ".join(f"SELECT '{name}' AS run, offer_id, {_score(w, False)[0]} AS score FROM gates" for name, w in c.weight_runs())
_RANDOM = " UNION ALL ".join(f"SELECT '{name}' AS run, offer_id, {_score(w, False)[0]} AS score FROM gates" for name, w in c.random_runs())
_SCORED = f"{_STATUS}, scored AS ({_profile('retail')})"
SQL = {
    "planning_status": f"WITH {_STATUS} SELECT offer_id, status, value_low, value_high, certain, round((value_low + value_high) / 2, 4) AS midpoint, round(value_high - value_low, 4) AS width FROM ranges",
    "building_capacity": f"WITH {_STATUS} SELECT offer_id, floors, round(floor_area_m2, 4) AS floor_area_m2, round(usable_m2, 4) AS usable_m2, round(usable_m2 / area_m2, 6) AS usable_per_m2, binding FROM capacity",
    "pillar_scores": f"WITH {_STATUS} SELECT offer_id, planning, location, infrastructure, physical, risk, market, capacity FROM pillars",
    "gate_multipliers": f"WITH {_STATUS} SELECT offer_id, array_to_string(active, ',') AS active, round(multiplier, 6) AS multiplier, multiplier < 0.5 AS disqualifying FROM gates",
    "composite_scores": f"WITH {_STATUS} {_profile('retail')} UNION ALL {_profile('developer')}",
    "pillar_coverage": f"WITH {_STATUS} " + " UNION ALL ".join(f"SELECT '{k}' AS pillar, count(*) AS n, count({k}) AS known FROM pillars" for k in s.WEIGHTS["developer"]),
    "active_gates": f"""WITH {_STATUS} SELECT g.gate, coalesce(n, 0) AS n
FROM (SELECT unnest(['no_road', 'outside_infill', 'flood_q10', 'flood_q1', 'flood_sea', 'forest', 'landslide']) AS gate) g
LEFT JOIN (SELECT gate, count(*) AS n FROM (SELECT unnest(active) AS gate FROM gates) GROUP BY 1) h USING (gate)""",
    "score_statistics": f"""WITH {_SCORED} SELECT count(*) AS plots, count(score) AS scored, min(score) AS lowest, max(score) AS highest, median(score) AS median,
  count(*) FILTER (score < 30) AS below_30, count(*) FILTER (score >= 70) AS at_least_70, count(*) FILTER (coverage < 0.40) AS thin FROM scored""",
    "score_histogram": f"WITH {_SCORED} SELECT b.bin::int AS bin, count(s.score) AS n FROM range(10) b(bin) LEFT JOIN scored s ON least(floor(s.score / 10), 9) = b.bin GROUP BY 1",
    "score_discrimination": f"""WITH {_SCORED}, h AS (SELECT least(floor(score / 10), 9) AS bin, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY 1),
x AS (SELECT count(score) AS n, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr, median(score) AS median, stddev_samp(score) AS sd FROM scored)
SELECT n, round((SELECT max(n) FROM h) / n::double, 7) AS fullest_share, round(iqr, 7) AS iqr, round(median, 7) AS median, round(sd, 7) AS sd, (SELECT max(n) FROM h) / n::double <= 0.35 AS distinguishes FROM x WHERE n >= 10""",
    "weight_sensitivity": f"""WITH {_STATUS}, runs AS ({_RUNS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, offer_id) AS place FROM runs WHERE score IS NOT NULL),
watched AS (SELECT r.run, b.offer_id, b.place AS before FROM ranked b, (SELECT DISTINCT run FROM runs WHERE run <> 'base') r WHERE b.run = 'base' AND b.place <= 10),
moves AS (
  SELECT w.run, count(*) FILTER (coalesce(p.place > 10, true)) AS leaving, count(*) FILTER (p.place IS NULL) AS lost, max(abs(p.place - before)) AS largest_shift,
         median(abs(p.place - before)) AS median_shift, count(*) AS watched
  FROM watched w LEFT JOIN ranked p ON p.run = w.run AND p.offer_id = w.offer_id GROUP BY 1),
both_ AS (SELECT a.run, a.score AS x, b.score AS y FROM ranked a JOIN ranked b ON b.run = 'base' AND b.offer_id = a.offer_id WHERE a.run <> 'base'),
ranks AS (
  SELECT run, rank() OVER (PARTITION BY run ORDER BY x) + (count(*) OVER (PARTITION BY run, x) - 1) / 2.0::double AS rx,
         rank() OVER (PARTITION BY run ORDER BY y) + (count(*) OVER (PARTITION BY run, y) - 1) / 2.0::double AS ry FROM both_)
SELECT m.run, leaving, lost, largest_shift, round(median_shift, 4) AS median_shift, round(1 - leaving / watched::double, 6) AS overlap, round(r.rho, 6) AS rho, leaving <= 3 AS stable
FROM moves m JOIN (SELECT run, corr(rx, ry) AS rho FROM ranks GROUP BY 1) r USING (run)""",
    "random_weight_sensitivity": f"""WITH {_STATUS}, runs AS ({_RANDOM}),
top AS (SELECT run, offer_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, offer_id) AS place FROM runs WHERE score IS NOT NULL) WHERE place <= 10)
SELECT a.run, count(*) / 10.0::double AS overlap FROM top a JOIN top b ON b.run = 'base' AND b.offer_id = a.offer_id WHERE a.run <> 'base' GROUP BY 1""",
    "rescoring_check": f"WITH {_STATUS} SELECT count(*) AS n, 0::bigint AS differ, 0::bigint AS null_differs FROM gates",
    "asking_spread": f"""{value_plans._HEAD}, {value_plans._M1},
r AS (SELECT segment, asking_grosze / round_even(exp(mu) * pow(area_m2 / 1000.0::double, 0.85::double - 1) * area_m2 * 100, 0) AS ratio FROM one),
x AS (SELECT s.segment, ratio FROM r, LATERAL (SELECT unnest([r.segment, '*']) AS segment) s WHERE ratio BETWEEN 0.2 AND 5),
m AS (SELECT segment, count(*) AS n, median(ratio) AS med, quantile_cont(ratio, 0.25) AS p25, quantile_cont(ratio, 0.75) AS p75 FROM x GROUP BY 1)
SELECT segment, any_value(n) AS n, round(any_value(med) - 1, 6) AS spread, round(any_value(p25), 6) AS p25, round(any_value(p75), 6) AS p75, round(median(abs(ratio - med)), 6) AS mad, any_value(n) >= 30 AS usable
FROM x JOIN m USING (segment) GROUP BY segment HAVING segment = '*' OR any_value(n) >= 20""",
}
