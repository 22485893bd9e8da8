"""Comparables in blocks against pairs of targets and sales, and how many sales a target reads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from plotlens.operators import stats, valuation

SALES = "tx_id string, tx_parcel string, tx_date date, tx_area double, tx_price_m2 double, tx_segment string, tx_precinct string, tx_municipality string, e double, n double"
DAY = dt.date(2001, 11, 4)


def _sales(r, n, days):
    out = []
    for i in range(n):
        muni, precinct = r.choice(("0201011", "0201021", "0202011", "0401011")), r.randrange(3)
        out.append((f"t{i:06d}", f"p{r.randrange(200)}", DAY - dt.timedelta(r.randrange(-20, days)), r.choice((100.0, 900.0, r.uniform(1, 20_000))), r.uniform(2, 900),
                    r.choice(("rolna", "lesna", "rekreacyjna", "droga")), f"{muni[:6]}_1.000{precinct}", muni, 0.0, 0.0))
    return out


def test_against_pairs(spark):
    r = random.Random(3)
    sales = spark.createDataFrame(_sales(r, 3000, 1300), SALES)
    targets = [(i, f"0201{r.choice('12'):0>2}_1.000{r.randrange(4)}.{i}", r.uniform(20, 5000), r.choice(("rolna", "lesna", "budowlana_wz")), DAY - dt.timedelta(r.randrange(300))) for i in range(30)]
    asked = spark.createDataFrame(targets, "target_id bigint, parcel_id string, area_m2 double, segment string, as_of date")
    chosen = valuation.select_segments(valuation.comparables(asked, sales, 100)).cache()
    clean = stats.drop_outliers(valuation.log_prices(chosen), ["target_id", "level"], "y")
    want = chosen.groupBy("target_id", "level").agg(F.count("*").alias("n"), F.max("segments_used").alias("s"), F.max("tx_date").alias("d")).join(stats.robust(clean, ["target_id", "level"], "y").withColumnRenamed("n", "c"), ["target_id", "level"])
    want = {(x.target_id, x.level): (x.n, x.s, x.d, x.c, round(x.median, 9), round(x.sigma, 9)) for x in want.collect()}
    got = {(x.target_id, x.level): (x.n, x.segments_used, x.newest, x.n_clean, round(x.median, 9), round(x.sigma, 9)) for x in valuation.level_medians(asked, sales, 100).collect()}
    assert got == want and len(want) > 60
    shown = valuation.shown_comparables(chosen).select("target_id", F.explode("shown").alias("s")).select("target_id", "s.place", "s.tx_id", "s.level")
    assert sorted(map(tuple, valuation.shown_sales(asked, sales, 12, 100).collect())) == sorted(map(tuple, shown.collect()))


def test_a_crowded_month_is_not_read_whole(spark):
    """20,000 sales of one month in one voivodeship, 300 wanted: few blocks of them are read."""
    i = F.col("id")
    sales = spark.range(20_000).select(
        F.concat(F.lit("t"), i).alias("tx_id"), F.lit("p").alias("tx_parcel"), F.date_sub(F.lit(DAY), (i % 28).cast("int")).alias("tx_date"), F.lit(900.0).alias("tx_area"), F.lit(50.0).alias("tx_price_m2"),
        F.lit("rolna").alias("tx_segment"), F.lit("020201_1.0001").alias("tx_precinct"), F.lit("0202011").alias("tx_municipality"), F.lit(50.0).alias("norm"), i.alias("at"),
    )
    coded = valuation.with_codes(spark.createDataFrame([(1, "020101_1.0001.5", 900.0, "rolna", DAY)], "target_id int, parcel_id string, area_m2 double, segment string, as_of date"))
    calendar = valuation._calendar(sales)
    met = valuation._met_blocks(valuation._needed_blocks(coded, sales, calendar, 300), sales, calendar)
    assert 300 <= met.agg(F.sum(F.size("sales"))).first()[0] <= 300 + 2 * 20_000 / 28
