"""Geometry by hand-computed shapes."""

import math

import pytest
from pyspark.sql import functions as F

from plotlens.functions import geo
from plotlens.operators import grid, layers


def ring(*points):
    return F.array(*[F.struct(F.lit(float(e)).alias("e"), F.lit(float(n)).alias("n")) for e, n in points])


SQUARE = ((0, 0), (30, 0), (30, 30), (0, 30), (0, 0))
BENT = ((0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0))


def test_measures(spark):
    r = ring(*SQUARE)
    row = spark.range(1).select(geo.area(r).alias("a"), geo.perimeter(r).alias("p"), geo.compactness(r).alias("c"), geo.centroid(r).alias("m"), geo.bounds(r).alias("b")).first()
    assert (row.a, row.p, row.m.e, row.m.n, tuple(row.b)) == (900.0, 120.0, 15.0, 15.0, (0.0, 0.0, 30.0, 30.0))
    assert row.c == pytest.approx(math.pi / 4)


def test_point_in_polygon(spark):
    cases = [((5, 2), True), ((5, 5), True), ((5, 7), False), ((0, 4), True), ((-1, 4), False), ((10, 10), True)]
    for (e, n), want in cases:
        assert spark.range(1).select(geo.covers(F.lit(float(e)), F.lit(float(n)), ring(*BENT)).alias("x")).first().x is want, (e, n)
    assert spark.range(1).select(geo.point_distance(F.lit(13.0), F.lit(4.0), ring(*BENT)).alias("x")).first().x == 3.0


def test_slope_and_cost(spark):
    north_south = F.array(*[F.lit(x) for x in (110.0, 110.0, 100.0, 90.0, 90.0, 90.0, 100.0, 110.0)])
    s, a = geo.slope(F.lit(100.0), north_south, 10.0)
    row = spark.range(1).select(s.alias("s"), a.alias("a"), geo.slope(F.lit(1.0), F.array(*[F.lit(1.0)] * 8), 10.0)[1].alias("flat")).first()
    assert (row.s, row.a, row.flat) == (pytest.approx(100.0), pytest.approx(180.0), None)
    cost = geo.utility_cost(F.create_map(F.lit("power"), F.lit(40.0), F.lit("water"), F.lit(150.0)))
    assert spark.range(1).select(cost.alias("c")).first().c == 4_500 + 17_500 + 16_500 + 35_000
    assert spark.range(1).select(geo.utility_cost(F.create_map().cast("map<string,double>")).alias("c")).first().c is None


def test_projection(spark):
    p = spark.range(1).select(geo.from_wgs84(F.lit(52.0), F.lit(19.0)).alias("p")).first().p
    assert p.e == pytest.approx(500_000.0) and p.n == pytest.approx(0.9993 * 5_763_343.55 - 5_300_000, abs=2.0)


def test_projection_and_back(spark):
    p = geo.from_wgs84(F.lit(54.35), F.lit(18.65))
    back = spark.range(1).select(p.alias("p")).select(geo.to_wgs84(F.col("p.e"), F.col("p.n")).alias("b")).first().b
    assert back.lat == pytest.approx(54.35, abs=1e-7) and back.lon == pytest.approx(18.65, abs=1e-7)


def test_wkt(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(f(geo.strip_srid(F.lit("SRID=2180;POLYGON((0 0))")))) == (2180, "POLYGON((0 0))") and tuple(f(geo.strip_srid(F.lit("POINT(1 2)")))) == (None, "POINT(1 2)")
    assert f(geo.strip_srid(F.lit("SRID=4326;POINT(1 2)"), 2180)).wkt is None
    rings = geo.rings_of_wkt(F.lit("POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,4 2,4 4,2 4,2 2))"))
    assert f(geo.polygon_area(rings)) == 96.0 and not f(geo.in_polygon(F.lit(3.0), F.lit(3.0), rings)) and f(geo.in_polygon(F.lit(2.0), F.lit(3.0), rings))


def test_zones_networks_and_terrain(spark):
    square = lambda x, y, w: [tuple(map(float, p)) for p in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]
    shape = "ring array<struct<e:double,n:double>>"
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 510.0, 10.0), (3, 9000.0, 0.0)], "k int, e double, n double")
    acts = spark.createDataFrame([("plan", square(0, 0, 1000))], f"act string, {shape}")
    zones = spark.createDataFrame([("SJ", {"maksWysokoscZabudowy": "9,5", "maksUdzialPowierzchniZabudowy": "-"}, square(0, 0, 100))], f"zone string, fields map<string,string>, {shape}")
    infill = spark.createDataFrame([(square(0, 0, 50),)], shape)
    out = {r.k: r for r in layers.planning_zones(points, "k", acts, zones, infill).collect()}
    assert [(out[i].general_plan, out[i].zone, out[i].buildable, out[i].infill) for i in (1, 2, 3)] == [(True, "SJ", True, True), (True, None, None, False), (False, None, None, None)]
    assert (out[1].indicators.height_m, out[1].indicators.footprint_pct, out[1].zone_name) == (9.5, None, layers.ZONES["SJ"])
    lines = spark.createDataFrame([("power", [(0.0, 40.0), (100_000.0, 40.0)]), ("water", [(0.0, 160.0), (400.0, 160.0)])], "medium string, line array<struct<e:double,n:double>>")
    net = {r.k: r for r in layers.utility_buckets(points, "k", lines).collect()}
    assert net[1].buckets == {"power": "<=50m", "water": "50-200m", "sewer": ">200m", "gas": ">200m"} and net[1].reachable == ["power", "water"] and net[1].utility_cost == 4_500 + 17_500 + 16_500 + 35_000
    assert net[2].in_service and net[2].reachable == ["power", "water"] and net[3].in_service and net[3].reachable == ["power"]
    heights = spark.createDataFrame([(float(x), float(y), 100.0 + 0.1 * x) for x in range(0, 40, 10) for y in range(0, 40, 10)], "e double, n double, height double")
    land = {r.k: r for r in layers.terrain(points, "k", heights).collect()}
    assert land[1].height == 101.0 and land[1].slope == pytest.approx(10.0) and land[1].aspect == 270 and land[2].height is None


def test_layers(spark):
    shape = "parcel_id string, ring array<struct<e:double,n:double>>"
    at = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    parcels = spark.createDataFrame([(name, [tuple(map(float, p)) for p in at(*a)]) for name, a in (("A", (0, 0, 30)), ("B", (40, 0, 30)), ("C", (500, 0, 100)))], shape)
    offers = spark.createDataFrame([(1, 10.0, 10.0, 900.0), (2, 35.0, 10.0, 900.0), (3, 550.0, 50.0, 900.0), (4, 5000.0, 0.0, 900.0), (5, 600.0, 50.0, None)], "offer_id int, e double, n double, declared_m2 double")
    assert {r.offer_id: (r.parcel_id, r.quality) for r in layers.match_parcels(offers, parcels).collect()} == {1: ("A", "high"), 2: ("A", "low"), 3: ("C", "low"), 5: (None, "none")}  # a point on a boundary is not in the parcel
    rivals = spark.createDataFrame([("P", [tuple(map(float, p)) for p in at(20, 0, 27.6)]), ("Q", [tuple(map(float, p)) for p in at(60, 0, 30)])], shape)  # area ratios 0.85 and 1
    near = spark.createDataFrame([(1, 10.0, 10.0, 900.0)], "offer_id int, e double, n double, declared_m2 double")
    assert [(r.parcel_id, r.quality) for r in layers.match_parcels(near, rivals).collect()] == [("Q", "medium")]
    wide = spark.createDataFrame([("P", [tuple(map(float, p)) for p in at(20, 0, 28.8)]), ("Q", [tuple(map(float, p)) for p in at(60, 0, 30)])], shape)  # 0.92 at 10 m, 1 at 50 m
    r = layers.match_parcels(near, wide).first()
    assert (r.parcel_id, r.quality, r.alternatives, r.usable) == ("Q", "medium", ["P"], True)
    big = spark.createDataFrame([("L", [tuple(map(float, p)) for p in at(-50_000, -50_000, 200_000)])], shape)
    assert layers.covering(offers, big).count() == 5
    holed = big.select(F.array("ring", F.array(*[F.struct(F.lit(float(x)).alias("e"), F.lit(float(y)).alias("n")) for x, y in at(0, 0, 30)])).alias("rings"))
    assert sorted(r.offer_id for r in layers.covering(offers, holed).collect()) == [2, 3, 4, 5]
    zones = parcels.select(F.lit("q1").alias("scenario"), "ring").where("parcel_id = 'A'").union(parcels.select(F.lit("q10").alias("scenario"), "ring").where("parcel_id <> 'B'"))
    assert {r.offer_id: r.floods for r in layers.flood_zones(offers, "offer_id", zones).collect()} == {1: ["q10", "q1"], 2: [], 3: ["q10"], 4: [], 5: ["q10"]}
    acts = spark.createDataFrame([(1, "x", False, "2020-01-01"), (1, "y", True, "2010-01-01"), (1, "z", True, None)], "k int, act string, in_force boolean, since string").withColumn("since", F.to_date("since"))
    assert layers.acts_in_force(acts, "k", "act", "in_force", "since").first().act == "y"


def test_points_that_are_none(spark):
    inf, nan = float("inf"), float("nan")
    left = spark.createDataFrame([(1, nan, 0.0), (2, 0.0, inf), (3, 3.0, 4.0), (4, None, 1.0), (5, -inf, nan)], "k int, e double, n double")
    right = spark.createDataFrame([(1, 0.0, 0.0), (2, nan, 4.0), (3, 3.0, -inf), (4, None, None)], "r int, e double, n double")
    assert [tuple(x) for x in grid.nearest(left, right, "k", "r", 1.0).collect()] == [(3, 1, 5.0)]
    assert [(x.k, x.r) for x in grid.within(left, right, 5.0).collect()] == [(3, 1)]
    assert grid.nearest(left, right.where("r > 1"), "k", "r", 1.0).count() == 0
    assert grid.tiles(left).agg({"n": "sum"}).first()[0] == 1
