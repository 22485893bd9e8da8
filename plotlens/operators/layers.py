"""Points against layers of polygons and lines, on grids whose cells fit the shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.functions import geo, text
from plotlens.operators.grid import cell, placed
from plotlens.operators.tessellation import covering, with_polygons
from plotlens.session import staged

#: Scenarios of the flood layers, the worst first in the order of the gates.
SCENARIOS = ("q10", "q1", "hWZ", "q0_2")
#: Zones of general plans and what they are for.
ZONES = {
    "SW": "wielofunkcyjna z zabudowa mieszkaniowa wielorodzinna", "SJ": "wielofunkcyjna z zabudowa mieszkaniowa jednorodzinna", "SZ": "wielofunkcyjna z zabudowa zagrodowa",
    "SU": "uslugowa", "SH": "handlu wielkopowierzchniowego", "SP": "gospodarcza", "SR": "produkcji rolniczej", "SI": "infrastrukturalna", "SN": "zieleni i rekreacji",
    "SC": "cmentarzy", "SG": "gornictwa", "SO": "otwarta", "SK": "komunikacyjna",
}
#: Attributes of a zone that hold its four building indicators.
INDICATORS = {
    "intensity": "maksNadziemnaIntensywnoscZabudowy", "footprint_pct": "maksUdzialPowierzchniZabudowy", "height_m": "maksWysokoscZabudowy", "green_pct": "minUdzialPowierzchniBiologicznieCzynnej",
}
#: A parcel's box meets a square of this half side around the point; no parcel is matched from farther; share and distance that tell rivals.
AROUND_M, FARTHEST_M, TOLERANCE, RIVAL_M = 150.0, 250.0, 0.10, 20.0
#: Where a network counts as visible.
VISIBLE_M = 200.0


def _outlined(shapes: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a layer and its outline: ``ring``, ``rings`` (with holes) or ``polygons`` (of several parts)."""
    return with_polygons(shapes).select(*columns, "polygons")


def _listed(shapes: DataFrame, box: Column, size: float) -> DataFrame:
    """``shapes`` once for each cell that the box touches, four at most: cells are as wide as the shape, in powers of two."""
    extent = F.greatest(box["e_max"] - box["e_min"], box["n_max"] - box["n_min"], F.lit(size))
    out = shapes.withColumn("__level", F.ceil(F.log2(extent / size)).cast("int")).withColumn("__box", box)
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("__level"))
    span = lambda low, high: F.sequence(F.floor(F.col(f"__box.{low}") / step), F.floor(F.col(f"__box.{high}") / step))
    cells = F.flatten(F.transform(span("e_min", "e_max"), lambda i: F.transform(span("n_min", "n_max"), lambda j: F.struct(i.alias("x"), j.alias("y")))))
    return out.where(F.col("__box.e_min").isNotNull()).withColumn("__cell", F.explode(cells)).drop("__box")


def _placed(points: DataFrame, listed: DataFrame, size: float) -> DataFrame:
    """``points`` once for each width of cells that the shapes have: a few, as widths double."""
    levels = [r[0] for r in listed.select("__level").distinct().collect()]
    at = [F.struct(F.lit(k).alias("level"), cell("e", "n", size * 2.0**k).alias("cell")) for k in levels]
    at = F.array(*at) if at else F.array().cast("array<struct<level:int,cell:struct<x:bigint,y:bigint>>>")
    return placed(points).select("*", F.explode(at).alias("__at")).select("*", F.col("__at.level").alias("__level"), F.col("__at.cell").alias("__cell")).drop("__at")


def lines_within(points: DataFrame, lines: DataFrame, radius: float, name: str = "dist_m") -> DataFrame:
    """Pairs of a point and a line (``line``) at most ``radius`` apart; a line is listed side by side, not by its box."""
    size = max(radius, 1.0)
    spots = staged(placed(points).withColumn("__p", F.monotonically_increasing_id()), "points")
    numbered = staged(lines.withColumn("__id", F.monotonically_increasing_id()), "lines")
    sides = numbered.select("__id", F.explode(geo.edges(F.col("line"))).alias("s"))
    s = F.col("s")
    box = F.struct(
        (F.least(s["e1"], s["e2"]) - radius).alias("e_min"), (F.least(s["n1"], s["n2"]) - radius).alias("n_min"),
        (F.greatest(s["e1"], s["e2"]) + radius).alias("e_max"), (F.greatest(s["n1"], s["n2"]) + radius).alias("n_max"),
    )
    listed = staged(_listed(sides, box, size), "line-cells")
    near = _placed(spots.select("__p", "e", "n"), listed, size).join(listed, ["__level", "__cell"])
    near = near.withColumn(name, geo.segment_distance(F.col("e"), F.col("n"), s)).where(F.col(name) <= radius)
    best = near.groupBy("__p", "__id").agg(F.min(name).alias(name))
    return spots.join(best, "__p").join(numbered, "__id").drop("__p", "__id")


def acts_in_force(pairs: DataFrame, key: str, act: str, in_force: str, since: str) -> DataFrame:
    """The act that counts at each point: one in force before any other, then the latest."""
    order = F.struct(F.col(in_force), F.coalesce(F.col(since), F.lit("0001-01-01").cast("date")), F.col(act))
    return pairs.groupBy(key).agg(F.max_by(F.struct(act, in_force, since), order).alias("r")).select(key, "r.*")


def local_plans(points: DataFrame, key: str, acts: DataFrame) -> DataFrame:
    """``(key, local_plan, act, since, n_acts)``: the act that counts at each point, and of how many like it.

    ``acts`` has ``(act, in_force, since)`` and an outline: a ``ring``, ``rings`` with holes, or ``polygons`` of several parts. Where one in force covers the point, others don't count.
    """
    hit = covering(points.select(key, "e", "n"), _outlined(acts, "act", "in_force", "since"))
    best = acts_in_force(hit, key, "act", "in_force", "since")
    counts = hit.groupBy(key).agg(F.count("*").alias("n"), F.count_if("in_force").alias("n_in_force"))
    out = points.select(key).join(best, key, "left").join(counts, key, "left")
    n = F.when(F.col("n_in_force") > 0, F.col("n_in_force")).otherwise(F.coalesce("n", F.lit(0)))
    return out.select(key, F.col("act").isNotNull().alias("local_plan"), "act", "since", n.alias("n_acts"))


def planning_zones(points: DataFrame, key: str, acts: DataFrame, zones: DataFrame, infill: DataFrame) -> DataFrame:
    """``(key, general_plan, act, zone, zone_name, buildable, infill, indicators)`` at each point.

    ``acts`` has ``act``, ``zones`` have ``zone`` and ``fields``, a map of raw attributes, and all three
    layers have an outline as in ``local_plans``. Without an act the infill is unknown; with one, no hit means outside.
    Of several hits the first by name counts.
    """
    spots = points.select(key, "e", "n")
    act = covering(spots, _outlined(acts, "act")).groupBy(key).agg(F.min("act").alias("act"))
    zone = covering(spots, _outlined(zones, "zone", "fields")).groupBy(key).agg(F.min_by(F.struct("zone", "fields"), F.struct("zone", F.to_json("fields"))).alias("z"))
    filled = covering(spots, _outlined(infill)).select(key).distinct().withColumn("hit", F.lit(True))
    out = points.select(key).join(act, key, "left").join(zone, key, "left").join(filled, key, "left")
    planned = F.col("act").isNotNull()
    symbol = F.when(planned, F.col("z.zone"))
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    values = F.struct(*[F.when(planned, text.indicator(F.try_element_at(F.col("z.fields"), F.lit(raw)))).alias(name) for name, raw in INDICATORS.items()])
    return out.select(
        key, planned.alias("general_plan"), "act", symbol.alias("zone"), F.try_element_at(names, symbol).alias("zone_name"), symbol.isin(*text.BUILDING_ZONES).alias("buildable"),
        F.when(planned, F.col("hit").isNotNull()).alias("infill"), values.alias("indicators"),
    )


def flood_zones(points: DataFrame, key: str, zones: DataFrame, order: tuple[str, ...] = SCENARIOS, checked: tuple[str, ...] = SCENARIOS) -> DataFrame:
    """``(key, floods, flood_checked)``: the scenarios whose zones cover a point, worst first, and whether all were looked at.

    ``checked`` are the scenarios whose layers could be read; no hit in another one says nothing.
    """
    hit = covering(points.select(key, "e", "n"), _outlined(zones.where(F.col("scenario").isin(*checked)), "scenario")).groupBy(key).agg(F.collect_set("scenario").alias("s"))
    ranked = F.filter(F.array(*[F.lit(o) for o in order]), lambda o: F.array_contains(F.col("s"), o))
    found = points.select(key).join(hit.select(key, ranked.alias("floods")), key, "left")
    return found.select(key, F.coalesce("floods", F.array().cast("array<string>")).alias("floods"), F.lit(set(checked) >= set(order)).alias("flood_checked"))


def utility_distances(points: DataFrame, key: str, networks: DataFrame, radius: float = 500.0) -> DataFrame:
    """``(key, distances)``: the distance of the nearest line of each medium within the radius, as a map."""
    near = lines_within(points.select(key, "e", "n"), networks.select("medium", "line"), radius)
    best = near.groupBy(key, "medium").agg(F.min("dist_m").alias("d"))
    return best.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("medium", "d")))).alias("distances"))


def utility_buckets(points: DataFrame, key: str, networks: DataFrame) -> DataFrame:
    """``(key, in_service, buckets, reachable, utility_cost)`` of every point.

    An area is in service if any network is visible within 200 m; a medium that is not is then
    farther off. Outside nothing is known, the cost included.
    """
    found = points.select(key).join(utility_distances(points, key, networks, VISIBLE_M), key, "left")
    known = F.coalesce(F.size("distances") > 0, F.lit(False))
    media = list(geo.UTILITY_COST)
    buckets = F.map_from_arrays(F.array(*[F.lit(m) for m in media]), F.array(*[geo.distance_bucket(F.try_element_at("distances", F.lit(m))) for m in media]))
    reach = F.filter(F.array(*[F.lit(m) for m in media]), lambda m: F.try_element_at(F.col("distances"), m) <= VISIBLE_M)
    return found.select(
        key, known.alias("in_service"), F.when(known, buckets).alias("buckets"), F.when(known, reach).otherwise(F.array().cast("array<string>")).alias("reachable"),
        F.when(known, geo.utility_cost(F.col("distances"))).alias("utility_cost"),
    )


def terrain(points: DataFrame, key: str, heights: DataFrame, step: float = 10.0) -> DataFrame:
    """``(key, height, slope, aspect)`` from a grid of heights ``(e, n, height)``: the nearest node and its eight neighbours.

    Without the node itself nothing is known; with a neighbour missing only the height is.
    """
    around = [(0, 0), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    node = lambda e, n: F.struct(F.round(e / step).cast("bigint").alias("x"), F.round(n / step).cast("bigint").alias("y"))
    own = node(F.col("e"), F.col("n"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), (own["x"] + x).alias("x"), (own["y"] + y).alias("y")) for i, (x, y) in enumerate(around)])
    asked = points.where("e is not null and n is not null").select(key, F.explode(offsets).alias("o")).select(key, "o.i", F.struct("o.x", "o.y").alias("node"))
    known = heights.groupBy(node(F.col("e"), F.col("n")).alias("node")).agg(F.min("height").alias("height"))
    held = asked.join(known, "node").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "height"))).alias("h"))
    at = lambda i: F.try_element_at(F.col("h"), F.lit(i))
    slope, aspect = geo.slope(at(0), F.array(*[at(i) for i in range(1, 9)]), step)
    return points.select(key).join(held.where(at(0).isNotNull()).select(key, at(0).alias("height"), slope.alias("slope"), F.round(aspect).cast("int").alias("aspect")), key, "left")


def match_parcels(offers: DataFrame, parcels: DataFrame, around: float = AROUND_M, farthest: float = FARTHEST_M, tolerance: float = TOLERANCE, rival_m: float = RIVAL_M) -> DataFrame:
    """``(offer_id, parcel_id, quality, far, ratio, alternatives, usable)`` of every offer with parcels around.

    A parcel around the point whose area fits the declared one is ``high``, of several the one that
    fits best. Else the best fitting area, then the nearest, is ``medium``, or ``low`` if the second
    of that order is as near to within ``rival_m``; of rows of one parcel id the smallest counts. Parcels
    have an outline as in ``local_plans``. Else a parcel around the point is ``low``; else
    the quality is ``none``. Ties go to the smaller parcel id. ``high`` and ``medium`` are usable.
    """
    e, n, polygons = F.col("e"), F.col("n"), F.col("polygons")
    of_one = F.min(F.struct(geo.polygons_area(polygons).alias("parcel_area"), "polygons")).alias("o")
    numbered = staged(_outlined(parcels, "parcel_id").groupBy("parcel_id").agg(of_one).select("parcel_id", "o.polygons", "o.parcel_area"), "parcels")
    box = geo.polygons_bounds(polygons)
    wide = F.struct((box["e_min"] - around).alias("e_min"), (box["n_min"] - around).alias("n_min"), (box["e_max"] + around).alias("e_max"), (box["n_max"] + around).alias("n_max"))
    listed = staged(_listed(numbered.select("parcel_id", wide.alias("wide")), F.col("wide"), 500.0), "parcel-cells")
    pairs = _placed(offers.select("offer_id", "e", "n", "declared_m2"), listed, 500.0).join(listed, ["__level", "__cell"])
    pairs = pairs.where(e.between(F.col("wide.e_min"), F.col("wide.e_max")) & n.between(F.col("wide.n_min"), F.col("wide.n_max"))).join(numbered, "parcel_id")
    pairs = pairs.withColumn("far", geo.polygons_distance(e, n, polygons)).where(F.col("far") <= farthest)
    known = (F.col("parcel_area") > 0) & (F.col("declared_m2") > 0)  # least and greatest skip nulls
    ratio = F.when(known, F.least("parcel_area", "declared_m2") / F.greatest("parcel_area", "declared_m2"))
    inside = geo.in_polygons(e, n, polygons) & (geo.polygons_line_distance(e, n, polygons) > 0)
    pairs = pairs.select("offer_id", "parcel_id", "far", ratio.alias("ratio"), inside.alias("inside")).withColumn("fits", F.coalesce(F.col("ratio") >= 1 - tolerance, F.lit(False)))
    pairs = staged(pairs, "parcel-pairs")
    one = F.struct((-F.coalesce("ratio", F.lit(0.0))).alias("worse"), "far", "parcel_id", "ratio")
    of = pairs.groupBy("offer_id").agg(
        F.min(F.when(F.col("inside") & F.col("fits"), one)).alias("high"), F.array_sort(F.collect_list(F.when(F.col("fits"), one))).alias("fitting"),
        F.min(F.when(F.col("inside"), F.struct("parcel_id", "far", "ratio"))).alias("around"), F.slice(F.array_sort(F.collect_list("parcel_id")), 1, 3).alias("first"),
    )
    best, second = F.get("fitting", F.lit(0)), F.get("fitting", F.lit(1))
    rival = F.coalesce(F.abs(best["far"] - second["far"]) < rival_m, F.lit(False))
    quality = F.when(F.col("high").isNotNull(), "high").when(best.isNotNull(), F.when(rival, "low").otherwise("medium")).when(F.col("around").isNotNull(), "low").otherwise("none")
    pick = lambda c: F.coalesce(F.col("high")[c], best[c], F.col("around")[c])
    others = F.when(F.col("high").isNull() & best.isNotNull(), F.transform(F.slice("fitting", 2, 3), lambda x: x["parcel_id"])).when(quality == "none", F.col("first"))
    return of.select(
        "offer_id", pick("parcel_id").alias("parcel_id"), quality.alias("quality"), pick("far").alias("far"), pick("ratio").alias("ratio"),
        F.coalesce(others, F.array().cast("array<string>")).alias("alternatives"), quality.isin("high", "medium").alias("usable"),
    )
