"""The first rows of many weight sets: no run is sorted, and no row is written once for each run."""

import random

from pyspark.sql import functions as F

from plotlens.operators import calibration, stats


def test_first_rows_hold_no_more_than_they_need(spark):
    draw = random.Random(3)
    rows = [(i, draw.randint(0, 9) / 2, None if i % 3 else draw.randint(0, 9) / 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, __base double, __other double")
    out = calibration.first_of(df, ["base", "other"], "k", 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2 and "WindowGroupLimit" not in plan
    want = [(run, k, s, i + 1) for run, at in (("base", 1), ("other", 2)) for i, (s, k) in enumerate((-a, b) for a, b in sorted((-r[at], r[0]) for r in rows if r[at] is not None)[:7])]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_rescored_rows_are_written_once(spark):
    df = spark.createDataFrame([(i, {"planning": float(i % 7), "location": float(i % 5), "risk": None}, 1.0) for i in range(40)], "k bigint, pillars map<string,double>, multiplier double")
    scores = calibration.rescored(df, calibration.weight_runs(), "k")
    assert scores.count() == 40
    assert calibration.by_run(scores, ["base", "risk_up"], "k").count() == 80


def test_spearman_of_counts(spark):
    draw = random.Random(4)
    rows = [(g, draw.randint(0, 6), draw.randint(0, 4)) for g in "ab" for _ in range(300)] + [("c", 1, 1), ("c", 1, 2)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = {r.g: r.rho for r in stats.spearman(df, ["g"], "x", "y").collect()}
    assert got["c"] != got["c"]
    for g in "ab":
        of = df.where(F.col("g") == g).toPandas()
        assert abs(got[g] - of["x"].rank().corr(of["y"].rank())) < 1e-12
