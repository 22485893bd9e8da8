"""Market medians, price dynamics, quarterly history and the local market of an offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.functions import codes, price
from plotlens.operators import hierarchy, stats
from plotlens.session import staged

#: Sales a year needs, the largest believed yearly change, and the pull towards the wider level.
YEAR_SALES, LARGEST_CHANGE, PULL = 10, 0.40, 30
#: Sales a median needs to be stored and to be relied on, and a quarter needs.
STORED, RELIABLE, QUARTER_SALES = 5, 10, 5


def market_sales(tx: DataFrame, as_of: str, since: Column | None = None) -> DataFrame:
    """Sales on the market: whole shares or unknown ones, traded freely, 5 a m2 at least, up to ``as_of``.

    Adds ``price_m2``, ``municipality`` and ``segment``.
    """
    priced = tx.withColumn("price_m2", F.try_divide(F.col("price_grosze"), F.lit(100)) / F.nullif(F.col("area_m2"), F.lit(0)))
    kept = priced.where(
        (F.col("price_m2") >= 5)
        & (F.col("sale_date") <= F.lit(as_of).cast("date"))
        & (F.col("share").isNull() | F.col("share").isin("1", "1/1"))
        & (F.col("trade").isNull() | F.col("trade").isin("wolnyRynek", "sprzedazPrzetargowa"))
    )
    if since is not None:
        kept = kept.where(F.col("sale_date") >= since)
    kept = kept.where(codes.has_municipality(F.col("parcel_id")))
    kept = kept.withColumn("municipality", codes.municipality(F.col("parcel_id")))
    return kept.withColumn("segment", codes.segment(F.col("land_use"), F.col("register_use")))


def medians(sales: DataFrame, as_of: str, dynamics: DataFrame | None = None) -> DataFrame:
    """``(level, area, segment, n, median_norm, p25_norm, p75_norm, median_raw)`` of areas with enough sales.

    Prices are those of a 1000 m2 plot, brought to ``as_of`` by the municipality's own dynamics
    (``level, area, cagr``) or by the usual drift. Segment ``*`` is all of them.
    """
    norm = price.normalised(F.col("price_m2"), F.col("area_m2").cast("double"))
    rows = sales.withColumn("norm", norm).withColumn("years", price.years_between(F.col("sale_date"), F.lit(as_of).cast("date")))
    if dynamics is None:
        rows = rows.withColumn("cagr", F.lit(None).cast("double"))
    else:
        own = dynamics.where("level = 'gmina'").select(F.col("area").alias("municipality"), "cagr")
        rows = rows.join(own, "municipality", "left")
    rows = rows.withColumn("today", price.indexed(F.col("norm"), F.col("cagr"), F.col("years")))
    rows = staged(rows.select("municipality", "segment", "today", "price_m2"), "market-sales")
    rows = hierarchy.at_levels(rows, "municipality").withColumn("segment", F.explode(F.array("segment", F.lit("*"))))
    keys = ["level", "area", "segment"]
    both = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("x")) for kind, c in (("norm", "today"), ("raw", "price_m2"))]))
    found = stats.quantiles(rows.select(*keys, both.alias("v")).select(*keys, "v.kind", "v.x"), ["kind", *keys], "x", [0.25, 0.5, 0.75], "p").where(F.col("n") >= STORED)
    norm, raw = found.where("kind = 'norm'"), found.where("kind = 'raw'").select(*keys, "n", F.col("p")[1].alias("raw"))
    return norm.select(*keys, "p").join(raw, keys).select(
        *keys, "n",
        F.round(F.col("p")[1], 2).alias("median_norm"), F.round(F.col("p")[0], 2).alias("p25_norm"), F.round(F.col("p")[2], 2).alias("p75_norm"),
        F.round("raw", 2).alias("median_raw"),
    )


def yearly_medians(sales: DataFrame) -> DataFrame:
    """``(level, area, segment, year, median, n)`` of normalised prices."""
    norm = price.normalised(F.col("price_m2"), F.col("area_m2").cast("double"))
    rows = staged(sales.select("municipality", "segment", F.year("sale_date").alias("year"), norm.alias("norm")), "yearly-sales")
    found = stats.quantiles(hierarchy.at_levels(rows, "municipality"), ["level", "area", "segment", "year"], "norm", [0.5])
    return found.select("level", "area", "segment", "year", F.col("q")[0].alias("median"), "n")


def dynamics(yearly: DataFrame) -> DataFrame:
    """``(level, area, cagr, n_obs, year_from, year_to, segments)``: the yearly change of each area.

    Per segment from the first to the last year with enough sales; wild changes are left out, the
    others weighted by the smaller of the two years' sales. Areas without any have no row.
    """
    good = yearly.where((F.col("n") >= YEAR_SALES) & (F.col("median") > 0))
    ends = good.groupBy("level", "area", "segment").agg(
        F.min("year").alias("y0"), F.max("year").alias("y1"), F.min_by("median", "year").alias("m0"), F.max_by("median", "year").alias("m1"),
        F.min_by("n", "year").alias("n0"), F.max_by("n", "year").alias("n1"),
    )
    change = ends.where("y1 > y0").withColumn("change", price.yearly_change(F.col("m0"), F.col("m1"), F.col("y1") - F.col("y0")))
    change = change.where(F.abs("change") <= LARGEST_CHANGE).withColumn("w", F.least("n0", "n1"))
    entries = F.array_sort(F.collect_list(F.struct("segment", "change")))
    return change.groupBy("level", "area").agg(
        (F.sum(F.col("change") * F.col("w")) / F.sum("w")).alias("cagr"), F.sum("w").alias("n_obs"),
        F.min("y0").alias("year_from"), F.max("y1").alias("year_to"), F.map_from_entries(entries).alias("segments"),
    )


def shrunk_dynamics(targets: DataFrame, areas: DataFrame, code: str = "municipality") -> DataFrame:
    """Each target with ``cagr`` mixed from its county and voivodeship, ``level``, ``n_obs`` and the levels' weights."""
    df = hierarchy.look_up(targets, code, areas.select("level", "area", "cagr", "n_obs"), "d")
    local, wide = F.lit(None).cast("double"), None
    weights = {}
    value = local
    for level, _ in reversed(hierarchy.LEVELS):
        own = F.col(f"d_{level}")
        lam = F.when(own.isNull(), F.lit(0.0)).when(value.isNull(), F.lit(1.0)).otherwise(own["n_obs"] / (own["n_obs"] + PULL))
        value = F.when(own.isNull(), value).when(value.isNull(), own["cagr"]).otherwise(lam * own["cagr"] + (1 - lam) * value)
        weights = {k: w * (1 - lam) for k, w in weights.items()} | {level: lam}
        wide = own if wide is None else F.coalesce(own, wide)
    shown = [F.when(F.col(f"d_{level}").isNotNull(), F.bround(weights[level], 3)).alias(f"weight_{level}") for level, _ in hierarchy.LEVELS]
    return df.select(*targets.columns, value.alias("cagr"), wide["level"].alias("level"), wide["n_obs"].alias("n_obs"), *shown)


def quarterly_history(sales: DataFrame, last_sale: Column | None = None) -> DataFrame:
    """``(level, area, quarter, label, median, p25, p75, n, complete)`` of quarters with enough sales.

    A quarter is complete when the area has a sale 92 days after its start or later.
    """
    norm = price.normalised(F.col("price_m2"), F.col("area_m2").cast("double"))
    rows = staged(sales.select("municipality", "sale_date", F.trunc("sale_date", "quarter").alias("quarter"), norm.alias("norm")), "quarterly-sales")
    rows = hierarchy.at_levels(rows, "municipality")
    last = rows.groupBy("level", "area").agg(F.max("sale_date").alias("last"))
    found = stats.quantiles(rows, ["level", "area", "quarter"], "norm", [0.25, 0.5, 0.75], "p")
    found = found.where(F.col("n") >= QUARTER_SALES).join(last, ["level", "area"])
    return found.select(
        "level", "area", "quarter", F.concat(F.year("quarter").cast("string"), F.lit(" Q"), F.quarter("quarter").cast("string")).alias("label"),
        F.col("p")[1].alias("median"), F.col("p")[0].alias("p25"), F.col("p")[2].alias("p75"), "n",
        (F.col("last") >= F.date_add("quarter", 92)).alias("complete"),
    )


def skipped_quarters(sales: DataFrame) -> DataFrame:
    """``(level, area, quarters, skipped)``: quarters with sales, and how many of them ``quarterly_history`` leaves out as too thin."""
    rows = sales.groupBy("municipality", F.trunc("sale_date", "quarter").alias("quarter")).agg(F.count("*").alias("c"))
    sums = hierarchy.at_levels(rows, "municipality").groupBy("level", "area", "quarter").agg(F.sum("c").alias("n"))
    return sums.groupBy("level", "area").agg(F.count("*").alias("quarters"), F.count_if(F.col("n") < QUARTER_SALES).alias("skipped"))


def imported(tx: DataFrame) -> DataFrame:
    """``(level, area, n, first, last)`` of all imported sales; those whose parcel has no valid code are area ``None``."""
    rows = tx.groupBy(codes.municipality(F.col("parcel_id")).alias("municipality")).agg(F.count("*").alias("c"), F.min("sale_date").alias("a"), F.max("sale_date").alias("b"))
    levels = hierarchy.at_levels(rows, "municipality").select("level", "area", "c", "a", "b")
    rest = rows.where("municipality is null").select(F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("area"), "c", "a", "b")
    return levels.union(rest).groupBy("level", "area").agg(F.sum("c").alias("n"), F.min("a").alias("first"), F.max("b").alias("last"))


def trends(history: DataFrame, quarters: int = 6, typical: int = 10, years: float = 2.0) -> DataFrame:
    """``(level, area, yearly)``: the median slope of the complete quarters' log prices, as a yearly change.

    Areas with too few quarters, thin ones or too short a span have no row.
    """
    points = history.where("complete and median > 0")
    start = points.groupBy("level", "area").agg(
        F.min("quarter").alias("start"), F.count("*").alias("quarters"), F.median("n").alias("typical"), F.max("quarter").alias("end")
    )
    good = start.where((F.col("quarters") >= quarters) & (F.col("typical") >= typical) & (price.years_between(F.col("start"), F.col("end")) >= years))
    rows = points.join(good, ["level", "area"]).select("level", "area", price.years_between(F.col("start"), F.col("quarter")).alias("x"), F.log("median").alias("y"))
    return stats.theil_sen(rows, ["level", "area"], "x", "y").select("level", "area", (F.exp("slope") - 1).alias("yearly"))


def local_market(offers: DataFrame, medians_: DataFrame) -> DataFrame:
    """Each offer with the median of its most local reliable market and its own deviation from it.

    Unit prices outside 1 to 5000 a m2 are not compared. Without a reliable median the one of the
    most sales counts, the more local one on a tie.
    """
    unit = F.col("price_grosze") / 100 / F.nullif(F.col("area_m2"), F.lit(0))
    rows = offers.withColumn("unit", F.when(unit.between(1, 5000), unit)).where("unit is not null and municipality is not null")
    rows = rows.withColumn("norm", price.normalised(F.col("unit"), F.col("area_m2").cast("double")))
    small = medians_.select("level", "area", "segment", "median_norm", "n")
    rows = hierarchy.look_up(rows, "municipality", small, "m", on=["segment"])
    reliable = hierarchy.most_local("m", lambda m: m["n"] >= RELIABLE)
    held = F.filter(F.array(*[F.struct(F.col(f"m_{level}.n").alias("n"), F.lit(-i).alias("i"), F.col(f"m_{level}").alias("m")) for i, (level, _) in enumerate(hierarchy.LEVELS)]), lambda x: x["n"].isNotNull())
    best = F.coalesce(reliable, F.try_element_at(F.sort_array(F.transform(held, lambda x: F.struct(x["n"], x["i"], x["m"])), asc=False), F.lit(1))["m"])
    rows = rows.withColumn("m", best)
    return rows.select(
        *offers.columns, F.round("norm", 2).alias("norm"), F.col("m.level").alias("median_level"), F.col("m.median_norm").alias("median_norm"),
        F.col("m.n").alias("median_n"), F.round(price.deviation(F.col("norm"), F.col("m.median_norm")), 4).alias("deviation"),
    )
