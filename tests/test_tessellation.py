"""Polygons cut into cells against the plain test of every point with every shape."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotlens.functions import geo
from plotlens.operators import layers
from plotlens.operators import tessellation as te

SHAPES = "s int, polygons array<array<array<struct<e:double,n:double>>>>"


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def star(r, cx, cy, size, k):
    points = [(cx + q * math.cos(2 * math.pi * i / k), cy + q * math.sin(2 * math.pi * i / k)) for i, q in enumerate(size * (0.4 + 0.6 * r.random()) for _ in range(k))]
    return [*points, points[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pair(spark, seed):
    r = random.Random(seed)
    # free places, round ones, and ones on the lines of the grid of cells
    place = lambda: r.choice((r.random() * 20_000, float(r.randrange(20) * 1000), te.ORIGIN[0] + r.randrange(40) * 500, te.ORIGIN[1] + r.randrange(40) * 500))
    shapes = []
    for i in range(30):
        x, y = place(), place()
        shapes.append((i, [
            [[box(x, y, place() + 20_001, place() + 20_001)]], [[star(r, x, y, 4000, r.randrange(3, 60)), star(r, x, y, 1000, 9)]], [[star(r, x, y, 800, 20)], [star(r, x + 50_000, y, 3000, 150)]],
            [[[(x, y), (x + 15_000, y + 9000), (x + 15_030, y + 9000), (x + 30, y), (x, y)]]], [[box(x, y, x + 6000, y + 6000), box(x + 1000, y + 1000, x + 2000, y + 5000), box(x + 3000, y + 500, x + 5000, y + 5500)]],
        ][i % 5]))
    points = [(place(), place()) for _ in range(1500)]
    corners = [p for _, polygons in shapes for rings in polygons for ring in rings for p in ring[:6]]
    points += corners + [((a + c) / 2, (b + d) / 2) for (a, b), (c, d) in zip(corners, corners[1:], strict=False)] + [(float("nan"), 1.0), (None, 1.0)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "p int, e double, n double")
    s = spark.createDataFrame([*shapes, (99, None), (98, [])], SHAPES)
    want = sorted((x.p, x.s) for x in p.crossJoin(s).where(geo.in_polygons(F.col("e"), F.col("n"), F.col("polygons"))).where("not isnan(e)").collect())
    got = te.covering(p, s)
    assert got.columns == ["p", "e", "n", "s"] and len(want) > 1000
    assert sorted((x.p, x.s) for x in got.collect()) == want


def test_a_long_shape_meets_points_along_its_border_only(spark):
    river = [[[(0.0, 0.0), (60_000.0, 41_000.0), (60_040.0, 41_000.0), (40.0, 0.0), (0.0, 0.0)]]]
    shapes = spark.createDataFrame([(1, river)], SHAPES).withColumn("id", F.lit(1).cast("long"))
    cells = te.cells_of(shapes, "id")
    assert cells.count() < 4 * 2 * 73_000 / te.SIZE_M
    points = spark.range(40_000).select("id", (F.rand(1) * 60_000).alias("e"), (F.rand(2) * 41_000).alias("n")).withColumnRenamed("id", "p")
    assert te.candidates(points, cells).count() < 40_000 * 0.03  # all 40,000 lie in its box


def test_layers_take_parts_and_holes(spark):
    two = [[box(0.0, 0.0, 30.0, 30.0), box(10.0, 10.0, 20.0, 20.0)], [box(100.0, 0.0, 110.0, 30.0)]]
    shape = "array<array<array<struct<e:double,n:double>>>>"
    parcels = spark.createDataFrame([("A", two), ("A", two), ("B", [[box(500.0, 0.0, 530.0, 30.0)]])], f"parcel_id string, polygons {shape}")
    offers = spark.createDataFrame([(1, 5.0, 5.0, 1100.0), (2, 15.0, 15.0, 1100.0), (3, 105.0, 5.0, 1100.0), (4, 50.0, 15.0, 300.0)], "offer_id int, e double, n double, declared_m2 double")
    got = {r.offer_id: (r.parcel_id, r.quality, r.far, r.alternatives) for r in layers.match_parcels(offers, parcels).collect()}
    # 800 + 300 m2; a hole and the gap are outside; a register with a repeated parcel has no rivals
    assert got[1] == ("A", "high", 0.0, []) and got[2] == ("A", "medium", 5.0, []) and got[3] == ("A", "high", 0.0, []) and got[4][1] == "none"
    zones = parcels.select(F.lit("q1").alias("scenario"), "polygons")
    assert {r.offer_id: r.floods for r in layers.flood_zones(offers, "offer_id", zones).collect()} == {1: ["q1"], 2: [], 3: ["q1"], 4: []}
    acts = parcels.where("parcel_id = 'A'").distinct().select(F.lit("plan").alias("act"), F.lit(True).alias("in_force"), F.lit(None).cast("date").alias("since"), "polygons")
    assert {r.offer_id: r.n_acts for r in layers.local_plans(offers, "offer_id", acts).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    all_ = layers.planning_zones(offers, "offer_id", acts, acts.select(F.lit("SJ").alias("zone"), F.create_map(F.lit("a"), F.lit("b")).alias("fields"), "polygons"), acts.select("polygons"))
    assert {r.offer_id: r.zone for r in all_.collect()} == {1: "SJ", 2: None, 3: "SJ", 4: None}
