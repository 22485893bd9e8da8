"""Sales are made once and their texts are looked at once."""

from pyspark.sql import functions as F

from plotlens.functions import codes
from plotlens.plans import market


def test_a_text_is_computed_once(spark, sf_dir):
    plan = market._sales(spark, sf_dir).select("municipality", "segment", "price_m2")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2  # the land use and the register's use; for each rule anew the code is too long to be compiled
    rows = [(None, None), (None, "las"), ("Brak MPZP lub WZ", "grunty rolne"), ("inny niewymieniony", None), ("teren rolniczy, produkcyjny", "x"), ("x", "grunty lesne"), ("", "")]
    out = spark.createDataFrame(rows, "a string, b string").select(codes.segment(F.col("a"), F.col("b")).alias("s"), codes.first_match(F.col("a"), codes.LAND_USE).alias("f")).collect()
    assert [r.s for r in out] == ["nieokreslona", "nieokreslona", "nieokreslona_rolna", "nieokreslona", "uslugowa_produkcyjna", "lesna", "nieokreslona"]
    assert [r.f for r in out] == [None, None, None, None, "uslugowa_produkcyjna", None, None]


def test_sales_are_joined_once(spark, sf_dir, monkeypatch):
    made = []
    sales = market._sales
    monkeypatch.setattr(market, "_sales", lambda *a, **k: made.append(a) or sales(*a, **k))
    from plotlens.plans import cards

    for query in (market.market_medians_indexed, market.market_dynamics_shrunk, market.regional_prices, cards.price_table):
        made.clear()
        query(spark, sf_dir)
        assert len(made) == 1
