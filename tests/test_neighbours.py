"""Nearest points and nearest eligible sales against every pair."""

import datetime as dt
import math
import random
import statistics

from pyspark.sql import functions as F

from plotlens.operators import grid, valuation

SALES = "tx_id string, tx_parcel string, tx_date date, tx_area double, tx_price_m2 double, tx_segment string, tx_precinct string, tx_municipality string, e double, n double"


def test_nearest_with_outliers_and_ties(spark):
    r = random.Random(5)
    spots = [(r.gauss(0, 300), r.gauss(0, 300)) for _ in range(200)] + [(90_000.0, -70_000.0), (-0.0, 0.0), (0.0, 0.0)]
    right = [(i, float(e), float(n)) for i, (e, n) in enumerate(spots + spots[:40])]
    left = [(i, r.choice((r.gauss(0, 500), r.uniform(-9e4, 9e4))), r.choice((r.gauss(0, 500), r.uniform(-9e4, 9e4)))) for i in range(300)] + [(300, None, 1.0), (301, math.nan, 1.0)]
    got = grid.nearest(spark.createDataFrame(left, "k int, e double, n double"), spark.createDataFrame(right, "r int, e double, n double"), "k", "r", 50.0)
    want = {k: min((math.sqrt((e - x) ** 2 + (n - y) ** 2), i) for i, x, y in right) for k, e, n in left if k < 300}
    found = {x.k: (x.dist_m, x.r) for x in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k][1] == want[k][1] and abs(found[k][0] - want[k][0]) < 1e-6 for k in want)


def _sales(r, n, spread, parcels):
    day = dt.date(2001, 11, 4)
    return [
        (f"t{i:06d}", f"p{r.randrange(parcels)}", day - dt.timedelta(r.randrange(-100, 1400)), r.choice((0.5, 3.0, 900.0, 1024.0, r.uniform(1, 20_000))), 100.0, "rolna", None, "020101_1", r.gauss(0, spread), r.gauss(0, spread))
        for i in range(n)
    ]


def test_nearest_sales_against_every_pair(spark):
    r = random.Random(9)
    sales = _sales(r, 4000, 4000.0, 60)
    day = dt.date(2001, 11, 4)
    targets = [(i, f"p{i}", r.choice((8.0, 20.0, 128.0, 1024.0, r.uniform(50, 5000))), r.gauss(0, 6000), r.gauss(0, 6000), "rolna", day - dt.timedelta(r.randrange(400))) for i in range(40)]
    asked = spark.createDataFrame(targets, "target_id int, parcel_id string, area_m2 double, e double, n double, segment string, as_of date")
    got = valuation.spatial_comparables(asked.union(asked.limit(3)), spark.createDataFrame(sales, SALES), 9000.0, 30)
    want = set()
    for t, parcel, area, e, n, _, at in targets:
        near = sorted(
            (math.sqrt((e - s[8]) ** 2 + (n - s[9]) ** 2), s[0]) for s in sales
            if at - dt.timedelta(1080) <= s[2] <= at and int(area / 8) <= s[3] <= int(area * 8) and s[1] != parcel
        )
        want |= {(t, k) for d, k in near[:30] if d <= 9000.0}
    rows = [(x.target_id, x.tx_id) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_a_dense_city_costs_no_more_than_what_is_fetched(spark):
    """40,000 eligible sales in 25 x 25 km, 20 wanted: the cells of a target hold few of them."""
    i = F.col("id")
    points = spark.range(40_000).select(i.alias("r"), ((i * 7919) % 25_000).cast("double").alias("e"), ((i * 104_729) % 25_000).cast("double").alias("n"))
    width, top = 300.0, 3
    cells = points.select(grid.cell("e", "n", width).alias("c")).groupBy("c.x", "c.y").agg(F.count("*").alias("held"))
    start = grid.around("e", "n", width * grid.FAN**top)
    asked = points.where("r % 400 = 0").withColumnRenamed("r", "k").withColumns({"need": F.lit(20), "limit": F.lit(15_000.0), "start": start})
    met = grid.closest_cells(asked, cells, "k", width, top).join(cells, ["x", "y"]).groupBy("k").agg(F.sum("held").alias("n")).agg(F.count("*"), F.max("n")).first()
    assert met[0] == 100 and met[1] <= 20 * 15


def test_cells_follow_the_density_of_sales(spark):
    """60,000 sales in 6 x 6 km, and 5,000 at one spot: cells of a fixed width hold ten times as many in a table ten times as dense."""
    i = F.col("id")
    sales = spark.range(60_000).select(((i * 7919) % 6_000).cast("double").alias("e2"), ((i * 104_729) % 6_007).cast("double").alias("n2"))
    width = valuation._cell_width(sales)
    held = sales.groupBy(grid.cell("e2", "n2", width).alias("c")).agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0]
    assert held <= 2 * valuation.CELL_SALES < 60_000 / 36 * (valuation.CELL_M / 1000) ** 2
    spot = spark.range(5000).select(F.lit(1.0).alias("e2"), F.lit(2.0).alias("n2"))
    assert valuation._cell_width(spot) == valuation.CELL_M


def test_quantiles_in_reach_against_every_pair(spark, monkeypatch):
    """Many blocks and chunks of a cell, missing values and points, rows at the radius itself; the plan holds no row of a pair."""
    monkeypatch.setattr(grid, "BLOCK", 50)
    monkeypatch.setattr(grid, "CHUNK", 4)
    r = random.Random(3)
    right = [(r.gauss(0, 900), r.gauss(0, 900), r.choice((None, 7.0, r.uniform(1, 900)))) for _ in range(600)] + [(500.0, 0.0, 5.0), (None, 1.0, 2.0)] + [(0.0, 0.0, 3.0)] * 300
    left = [(f"t{i}", r.gauss(0, 1200), r.gauss(0, 1200)) for i in range(40)] + [("edge", 0.0, 0.0), ("far", 9e6, 0.0), ("none", None, 0.0)]
    got = grid.within_quantiles(spark.createDataFrame(left, "k string, e double, n double"), spark.createDataFrame(right, "e double, n double, v double"), "k", "v", 500.0, [0.5])
    want = {}
    for k, e, n in left[:-1]:
        near = [(math.sqrt((e - x) ** 2 + (n - y) ** 2), v) for x, y, v in right if x is not None]
        near = [(d, v) for d, v in near if d <= 500.0]
        if near:
            known = [v for _, v in near if v is not None]
            want[k] = (len(near), min(d for d, _ in near), statistics.median(known) if known else None)
    found = {x.k: (x.n, x.nearest, x.q and x.q[0]) for x in got.collect()}
    assert found.keys() == want.keys() and "edge" in want
    off = [(k, found[k], want[k]) for k in want if found[k][0] != want[k][0] or abs(found[k][1] - want[k][1]) > 1e-9 or abs((found[k][2] or 0) - (want[k][2] or 0)) > 1e-9]
    assert off == []
