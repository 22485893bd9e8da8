"""Ties that arithmetic misses by a bit."""

from pyspark.sql import functions as F

from plotlens.functions.price import scaled
from plotlens.operators.scoring import mean_of


def test_missed_ties_are_rounded_half_to_even(spark):
    costs = [(139_425, 7.0), (62_025, 58.6), (54_975, 63.4), (59_025, 60.6), (110_175, 26.6), (69_975, 53.4)]
    df = spark.createDataFrame([(c, w) for c, w in costs], "cost int, want double")
    points = scaled(F.col("cost").cast("double"), 0, 150_000, True)
    assert all(r.got == r.want for r in df.select("want", points.alias("got")).collect())
    assert df.where("cost = 54975").select(mean_of(points, F.lit(60.0), F.lit(None))).first()[0] == 61.7
